"""Language-model scoring by deleted interpolation of n-grams.

P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1), with the mixture weights a chosen by how often the
context v was seen (buckets of doubling frequency) and learned by expectation-maximisation on the documents held out. Counts come from
the other documents.

Texts are gathered into chunks once. A chunk sends its distinct unigrams and bigrams, as sorted 64-bit hashes with its own counts, to
buckets of the hash; a bucket sums them and answers each chunk with the corpus counts in the chunk's own order, so that no
table of counts is held anywhere. The held-out tokens are counted by (context bucket, rounded ratios), which is all that
expectation-maximisation needs and does not grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, partitions_for, table, with_text_bytes
from .kernels import LOWER, Words, merge_counts, mix, pack_ints, pack_sorted, shared_buckets, slices, unpack_ints, unpack_sorted

CHUNK, TOKENS = 6 << 20, 400_000
FOLDS, HELD = 5, 1
#: Steps of a ratio's rounding in an octave, for the held-out counts alone; context buckets with fewer held-out tokens share the pooled weights.
STEPS, LEAST = 8, 200
_U = np.uint64
END, BEGIN = _U(0x8A5CD789635D2DFF), _U(0x121FD2155C472F96)
_CHUNK = "chunk long, held boolean, ids array<long>, offs binary, z binary, n_bytes long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3)
    task, sent = TaskContext.get().partitionId(), 0
    held: dict[bool, list] = {False: [], True: []}
    sizes = {False: 0, True: 0}

    def flush(side):
        nonlocal sent
        data = b"".join(d for _, d in held[side])
        offs = np.cumsum([0] + [len(d) for _, d in held[side]])
        ids = [i for i, _ in held[side]]
        held[side], sizes[side] = [], 0
        sent += 1
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | sent - 1]), pa.array([side]), pa.array([ids], pa.list_(pa.int64())), pa.array([pack_ints(offs.astype(np.int64))], pa.binary()), pa.array([press.compress(data)], pa.binary()), pa.array([len(data)])], ["chunk", "held", "ids", "offs", "z", "n_bytes"])

    for batch in batches:
        for part, data, offs in slices(batch):
            data = LOWER[data]
            for doc, a, b in zip(part.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                side = zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD
                held[side].append((doc, data[a:b].tobytes()))
                sizes[side] += b - a + 64
                if sizes[side] >= CHUNK:
                    yield flush(side)
    for side in held:
        if held[side]:
            yield flush(side)


def _tokens(z: bytes, offs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk, the token before each, and offsets by document. Each document ends with END and follows BEGIN."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    offs = unpack_ints(offs, np.int64)
    hashes, counts, at = [], [], 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (2 << 20), "right")) - 1)
        part = data[offs[at] : offs[to]]
        words = Words(part, offs[at : to + 1] - offs[at])
        hashes.append(words.hashes(part))
        counts.append(words.counts)
        at = to
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    bounds = np.concatenate(([0], np.cumsum(counts + 1)))
    tokens = np.full(bounds[-1], END, _U)
    inner = np.ones(len(tokens), bool)
    inner[bounds[1:] - 1] = False
    tokens[inner] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def _pairs(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _U(0x9E3779B97F4A7C15) + tokens)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, offs, z in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens, before, _ = _tokens(z, offs)
                for order, keys in ((1, tokens), (2, _pairs(tokens, before))):
                    keys, counts = np.unique(keys, return_counts=True)
                    rows = [(b, pack_sorted(keys[lo:hi]), None if held else pack_ints(counts[lo:hi].astype(np.uint32))) for b, (lo, hi), _ in shared_buckets(keys, keys[:0], buckets)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([order] * len(rows), pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                        ["bucket", "n", "chunk", "keys", "counts"],
                    )

    return run


_REPLY = "chunk long, n int, bucket int, counts binary, kinds long, total long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of each chunk's keys, in its order; for unigrams also how many kinds and tokens there are."""
    at, held = None, []

    def done():
        bucket, order = at
        keys = [unpack_sorted(k) for _, k, _ in held]
        counts = [np.zeros(len(k), np.int64) if c is None else unpack_ints(c, np.uint32).astype(np.int64) for k, (_, _, c) in zip(keys, held)]
        key, total = merge_counts(keys, counts)
        rows = [(chunk, pack_ints(total[np.searchsorted(key, k)]), None, None) for k, (chunk, _, _) in zip(keys, held)]
        if order == 1:
            rows.append((-1, None, int((total > 0).sum()), int(total.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([order] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["chunk", "n", "bucket", "counts", "kinds", "total"])

    for batch in batches:
        for bucket, order, chunk, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (bucket, order) != at:
                if held:
                    yield from done()
                at, held = (bucket, order), []
            held.append((chunk, keys, counts))
    if held:
        yield from done()


def _counted(offs: bytes, z: bytes, replies: list[dict]):
    """Tokens of a chunk with the corpus counts of word, context and pair."""
    tokens, before, bounds = _tokens(z, offs)
    found = {}
    for order, keys in ((1, tokens), (2, _pairs(tokens, before))):
        kinds, inverse = np.unique(keys, return_inverse=True)
        counts = np.concatenate([unpack_ints(r["counts"], np.int64) for r in sorted((r for r in replies if r["n"] == order), key=lambda r: r["bucket"])]).astype(np.int64)
        found[order] = counts[inverse]
        if order == 1:
            ends = counts[np.searchsorted(kinds, END)]
    context = np.empty(len(tokens), np.int64)
    context[1:] = found[1][:-1]
    context[bounds[:-1]] = ends  # every training document has one beginning and one end
    return found[1], context, found[2], bounds


def _level(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _histogram(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offs, z, replies in zip(*(batch.column(i).to_pylist() for i in range(3))):
                word, context, pair, _ = _counted(offs, z, replies)
                with np.errstate(divide="ignore", invalid="ignore"):
                    q1 = np.where(word > 0, np.round(STEPS * np.log2(word / total)), 1)
                    q2 = np.where(pair > 0, np.round(STEPS * np.log2(pair / context)), 1)
                rows, n = np.unique(np.stack((_level(context), q2.astype(np.int64), q1.astype(np.int64)), 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(n.astype(np.int64))], ["level", "q2", "q1", "n"])

    return run


def learn(level: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float, n: np.ndarray, least: int = LEAST, rounds: int = 500) -> dict[int, np.ndarray]:
    """Mixture weights (pair, word, uniform) by context level, by expectation-maximisation on held-out counts; -1: pooled over levels."""
    floor = np.array([0.0, 0.0, 1e-6])

    def fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        a = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * a
            new = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0)
            new = np.maximum(new / new.sum(), floor)
            new /= new.sum()
            if np.abs(new - a).max() < 1e-9:
                break
            a = new
        return a

    p = np.stack((f2, f1, np.full(len(f2), f0)), 1)
    out = {-1: fit(p, n) if len(n) else np.full(3, 1 / 3)}
    for x in np.unique(level).tolist():
        here = level == x
        if n[here].sum() >= least:
            out[x] = fit(p[here], n[here])
    return out


def _score(total: int, kinds: int, weights: dict[int, np.ndarray]):
    table_ = np.stack([weights.get(i, weights[-1]) for i in range(64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, ids, offs, z, replies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                word, context, pair, bounds = _counted(offs, z, replies)
                a = table_[_level(context)]
                p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(total, 1) + a[:, 2] / (kinds + 1)
                base = np.log10((word + 0.5) / (total + 0.5 * (kinds + 1)))
                add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every document has a token
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([held] * len(ids)), pa.array(np.diff(bounds)), pa.array(add((word > 0).astype(np.int64))), pa.array([total] * len(ids), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id and text; other columns are ignored. Held out are documents with crc32(doc_id as text) mod 5 = 1; the others are
    learned from. Tokens are words in lower case (A-Z) and one end; a null or empty text is the end alone. base_score: sum of
    log10((c + 0.5) / (N + 0.5 * (V + 1))); score: log10 of the model's probability of the text. A null doc_id is learned from.
    Repeated rows count and come back each; texts of any length are scored whole. Without held-out documents the weights are equal. An empty table gives an empty table."""
    chunks = cut(with_text_bytes(docs).mapInArrow(_gather, _CHUNK))
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = partitions_for(size // 6, TOKENS)
    asked = chunks.select("chunk", "held", "offs", "z").mapInArrow(_ask(buckets), "bucket int, n int, chunk long, keys binary, counts binary")
    replies = cut(asked.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(_answer, _REPLY))
    kinds, total = replies.where("chunk = -1").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def joined(chunks: DataFrame) -> DataFrame:
        lists = replies.where("chunk >= 0").join(chunks.select("chunk"), "chunk", "left_semi").groupBy("chunk").agg(F.collect_list(F.struct("n", "bucket", "counts")).alias("replies"))
        return chunks.join(lists, "chunk")

    held = chunks.where("held")
    hist = joined(held).select("offs", "z", "replies").mapInArrow(_histogram(max(total, 1)), "level long, q2 long, q1 long, n long").groupBy("level", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("level", "q2", "q1").toPandas()
    ratio = lambda q: np.where(q > 0, 0.0, 2.0 ** (np.minimum(q, 0) / STEPS))
    weights = learn(hist["level"].to_numpy(np.int64), ratio(hist["q2"].to_numpy(float)), ratio(hist["q1"].to_numpy(float)), 1 / (kinds + 1), hist["n"].to_numpy(float))
    rows = joined(chunks).select("held", "ids", "offs", "z", "replies")
    return rows.mapInArrow(_score(total, kinds, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
