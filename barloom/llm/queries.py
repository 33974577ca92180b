"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, contamination, linededup, manifest, media, mixing, pii, quality, simhash, substring, tokencounts, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_media": media.op7_media,
    "op8_pii": pii.op8_pii,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_decontamination": contamination.op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
    "op13_decontamination": contamination.OP13_SQL,
}
