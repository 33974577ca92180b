"""Expressions over panels."""
