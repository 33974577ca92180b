"""Structured Streaming forms of the bar builder and the rule monitor."""
