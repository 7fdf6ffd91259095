"""Stages of the corpus pipeline: each takes documents and returns documents that its operator kept. Verdicts act on rows, also
where a doc_id is null or several rows share it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import cut, free, without_ids
from .minhash import near_duplicates
from .mixing import mixed
from .packing import pack
from .quality import kept_rows
from .suffix import repeated_spans, without_spans


def _named(docs: DataFrame) -> bool:
    """Whether doc_id names each row."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def _by_row(stage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A stage that names rows by doc_id, for tables with null or shared ids too: there it gets keys of the rows instead, in the order of
    doc_id (nulls last), and its rows get their doc_id back."""

    @functools.wraps(stage)
    def run(docs: DataFrame) -> DataFrame:
        if _named(docs):
            return stage(docs)
        order = F.asc_nulls_last("doc_id")
        ordered = docs.repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"))
        (own,) = free(docs, "own_id")
        keyed = cut(ordered.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()))
        return stage(keyed).withColumn("doc_id", F.col(own)).select(*docs.columns)

    return run


def quality_stage(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself. A null text goes; a null doc_id or language does not matter, repeated rows
    share their verdict, and an empty table stays empty."""
    return kept_rows(docs)


@_by_row
def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates (five-word shingles, similarity 0.8); rows with a null doc_id
    come after the others. Texts without a word are no duplicates of each other. Of equal rows one stays. An empty table stays empty."""
    return without_ids(docs, cut(near_duplicates(docs, size=5, similarity=0.8).where("not kept").select("doc_id")))


@_by_row
def passage_stage(docs: DataFrame) -> DataFrame:
    """Documents without the passages of 100 bytes or more that start earlier (rows with a null doc_id come last); what has no word left goes, null
    and empty texts too. n_chars, where there is such a column, follows the text. Of equal rows of 100 bytes or more one stays. An empty table stays empty."""
    spans = repeated_spans(docs, 100)
    left = without_spans(docs, spans)
    left = left.where(F.col("text").isNotNull()).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def mixing_stage(docs: DataFrame) -> DataFrame:
    """Rows as often as the mix of sources takes them, 0 to 3 times; that depends on doc_id and source alone. A null source is a source, a null
    doc_id an id, a null text has no words. Equal rows are taken equally often. An empty table stays empty."""
    return mixed(docs)


def packing_stage(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token sequences of at most 2048: a row for each piece of a document, as op2 has them. A null or empty text is its end alone; rows that
    are there several times are packed as often, a null doc_id stays null; an empty table gives no rows. Workers of a pipeline have other stages to serve, so that they remember
    fewer pieces of text and nothing beyond a task."""
    return pack(docs, tokenizer, remembered=250_000, lasting=False)
