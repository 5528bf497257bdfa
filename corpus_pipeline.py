"""From raw documents to packed sequences, in five stages; each reads what the one before it wrote.

A stage takes any table with doc_id, source and text: nulls in any column, repeated rows, empty and very long
texts, an empty table and extra columns of any name, which pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import line_dedup, mixing, ngram_join, packing, toxicity
from siftwell.llm.common import materialize, packed, table

#: The n-gram join of the pipeline: words in a token, least similarity in hundredths.
WORDS, PERCENT = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labels, does not call toxic.

    Null and empty texts are scored like any other. Repeated rows share a score.
    """
    machine = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    whole, unpack = packed(docs, "text")
    return unpack(toxicity.score(whole, machine).where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document of which only white space is left goes.

    A null or empty text and one that was only white space before stay. Rows that repeat doc_id and text are treated alike.
    """
    whole, unpack = packed(docs, "doc_id", "text")
    out = line_dedup.dedup(whole)
    blank = F.trim(F.translate("text", "\t\r\n", "   ")) == ""
    return unpack(out.where(F.col("text").isNull() | (F.col("n_removed") == 0) | ~blank))


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones.

    Rows without words, or without any id in the group, stay; so do all rows that repeat the kept id within the group.
    """
    whole, unpack = packed(docs, "doc_id", "text")
    out = ngram_join.join(whole, WORDS, PERCENT)
    return unpack(out.where((F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks; a null source is a source, a null text has no words."""
    whole, unpack = packed(docs, "doc_id", "text", "source")
    return unpack(mixing.emit(mixing.mix(whole)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their places, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", similar),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", sequences),
]

#: SQL can express neither the machine's scores nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
