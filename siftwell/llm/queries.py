"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bm25, centroids, licenses, line_dedup, mixing, ngram_join, packing, pii, spelling, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25": bm25.op1_bm25,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_warc": warc.op6_warc,
    "op7_ann": ann.op7_ann,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_licenses": licenses.op11_licenses,
    "op12_spelling": spelling.op12_spelling,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES: dict[str, str] = {
    "op1_bm25": bm25.SQL,
    "op3_mixing": mixing.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op6_warc": warc.SQL,
    "op7_ann": ann.SQL,
    "op9_url_filter": url_filter.SQL,
    "op11_licenses": licenses.SQL,
    "op12_spelling": spelling.SQL,
    "op13_centroids": centroids.SQL,
}
