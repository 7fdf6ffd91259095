"""Token counts as delta-maintained rollups.

A batch of changes becomes signed rows: an insert adds a document and its tokens, a delete takes them away, a revision does both. The batch's sums
by source, language and tokenizer version are one small delta, written to a folder of its own. What commits it is a marker, a file with the batch's name that is
created only if there is none and that names the folder: a batch with a marker is skipped, so that replays change nothing, and a failed attempt leaves only
a folder that nothing names. Totals are sums of deltas that markers name. Compaction sums exactly the deltas it listed into a base, whose marker names the
batches folded into it; a batch committed meanwhile is not among them and stays a delta. Folded files are removed by the compaction after, so that readers that
have planned on them find them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, shared_dir, table
from .encoding import encoder
from .kernels import Words, slices

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, documents long, tokens long, batch string"


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, version, documents, tokens), positive or negative, of changes.

    changes: op (insert, delete or revise), source, lang, version, tokens; a revise has what it replaces in
    old_source, old_lang, old_version, old_tokens, and is an error where there are no such columns. With a change_id, rows that share one count once, the smallest of
    them by all columns; rows whose change_id is null, or without that column, count each. A null source, language or version is a
    key of its own, null tokens are 0, a null op or another one is an error. Other columns are ignored; no rows give no rows."""
    old = [f"old_{k}" for k in (*KEYS, "tokens")]
    whole = all(c in changes.columns for c in old)
    names = ["op", *KEYS, "tokens", *(old if whole else [])]
    rows = changes.select(*names, *(["change_id"] if "change_id" in changes.columns else []))
    if "change_id" in changes.columns:
        once = rows.where("change_id is not null").groupBy("change_id").agg(F.min(F.struct(*names)).alias("r")).select("r.*")
        rows = rows.where("change_id is null").select(*names).unionByName(once)
    op = F.lower(F.col("op"))
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null")))))
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    sign = F.when(known == "delete", -1).otherwise(1)
    part = lambda prefix, s, t: F.struct(*(F.col(prefix + k).cast("string").alias(k) for k in KEYS), s.cast("long").alias("documents"), (t * s).cast("long").alias("tokens"))
    one = F.array(part("", sign, tokens))
    if whole:
        both = F.array(part("", sign, tokens), part("old_", F.lit(-1), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))))
    else:
        both = F.raise_error(F.lit(f"a revise needs the columns {', '.join(old)}")).cast("array<struct<source:string,lang:string,version:string,documents:bigint,tokens:bigint>>")
    return rows.select(F.explode(F.when(known == "revise", both).otherwise(one)).alias("r")).select("r.*")


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals under a folder that all executors and the driver share. The driver holds the names of batches, never their rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read(self, name: str) -> dict | None:
        """A marker's content; None if there is none, or one that its writer did not finish."""
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _mark(self, name: str, content: dict) -> bool:
        """Creates a marker. False if there is one; what a writer left unfinished is replaced."""
        if self._fs.exists(self._path(name)):
            if self._read(name) is not None:
                return False
            self._fs.delete(self._path(name), False)
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(n for f in self._fs.listStatus(self._path(folder)) if not (n := f.getPath().getName()).startswith((".", "_")))

    def _base(self) -> tuple[int, dict]:
        """Number and content of the newest compaction."""
        for name in reversed(self._names("bases")):
            found = self._read(f"bases/{name}")
            if found is not None:
                return int(name), found
        return -1, {"sums": None, "folded": [], "fresh": {}}

    def batches(self) -> list[str]:
        """Names of committed batches."""
        return [n for n in self._names("commits") if self._read(f"commits/{n}") is not None]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once. False if it was committed before."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._read(f"commits/{batch}") is not None:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        sums(signed(changes)).withColumn("batch", F.lit(batch)).coalesce(1).write.parquet(f"{self.root}/{folder}")
        if self._mark(f"commits/{batch}", {"folder": folder}):
            return True
        self._fs.delete(self._path(folder), True)
        return False

    def _open(self, base: dict) -> dict[str, str]:
        """Folders of committed batches that the base has not folded, by name."""
        folded = set(base["folded"])
        found = {n: self._read(f"commits/{n}") for n in self._names("commits") if n not in folded}
        return {n: m["folder"] for n, m in found.items() if m is not None}

    def _rows(self, base: dict, deltas: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in (*deltas.values(), *([base["sums"]] if base["sums"] else []))]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over committed batches; keys without documents and tokens are left out."""
        _, base = self._base()
        return sums(self._rows(base, self._open(base))).where("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Folds the batches that are committed now into one base. False if another compaction came first."""
        number, base = self._base()
        deltas = self._open(base)
        folder = f"data/{uuid.uuid4().hex}"
        sums(self._rows(base, deltas)).withColumn("batch", F.lit(None).cast("string")).coalesce(1).write.parquet(f"{self.root}/{folder}")
        if not self._mark(f"bases/{number + 1:012d}", {"sums": folder, "folded": sorted([*base["folded"], *deltas]), "fresh": deltas, "before": base["sums"]}):
            self._fs.delete(self._path(folder), True)
            return False
        # What the compaction before this one replaced is no longer planned on.
        for old in (*base["fresh"].values(), base.get("before")):
            if old:
                self._fs.delete(self._path(old), True)
        return True


def token_counts(docs: DataFrame, vocabularies: dict[str, str], special_as_text: bool = False) -> DataFrame:
    """source, lang, n_words and, under each vocabulary's name, the ids of the text by it: a row for each document. vocabularies: name to path.

    docs: text, source, lang; other columns are ignored. A null or empty text has 0 of each."""
    names = list(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [encoder(vocabularies[n], special_as_text=special_as_text) for n in names]
        for batch in batches:
            for part, data, offs in slices(batch):
                counts = [Words(data, offs).counts, *(e.counts(data, offs) for e in made)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(c, pa.int64()) for c in counts)], ["source", "lang", "n_words", *names])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "source string, lang string, n_words long, " + ", ".join(f"`{n}` long" for n in names))


#: Versions that the query counts by, the first before the second.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def history(rollup: Rollup, counts: DataFrame) -> None:
    """All documents of token_counts() through four batches: inserted with their tokens by the first version; revised to the second; those with fewer than 20
    words deleted; the revision sent again, which changes nothing."""
    first, second = VERSIONS
    row = lambda rows, op, version, *more: rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.col(version).alias("tokens"), *more)
    old = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(first).alias("old_version"), F.col(first).alias("old_tokens")]
    revised = row(counts, "revise", second, *old)
    for name, changes in (("1-insert", row(counts, "insert", first)), ("2-revise", revised), ("3-delete", row(counts.where("n_words < 20"), "delete", second)), ("2-revise", revised)):
        rollup.commit(name, changes)


def op10_delta_rollup(spark, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version after history()."""
    import public_tokenizers

    paths = dict(zip(VERSIONS, map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))))
    rollup = Rollup(spark, f"{shared_dir(spark)}/flowsieve/rollup-{uuid.uuid4().hex}")
    history(rollup, cut(token_counts(table(spark, sf_dir, "documents"), paths)))
    return rollup.totals()
