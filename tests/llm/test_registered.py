"""The registered queries themselves, on a whole small table, against plain versions; and the pipeline as a whole."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from flowsieve.llm import quality as q, queries

from . import brute
from .test_packing import check
from .test_sharding_mixing import check_shards

Q = {n.split("_")[0]: f for n, f in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def table(spark):
    from ..conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def texts(table):
    return [(r.doc_id, r.text) for r in table]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op1(spark, sf, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q["op1"](spark, sf).collect()} == brute.near_duplicates(texts, 4, 80)


def test_op2(spark, sf, texts, tokenizer):
    rows = Q["op2"](spark, sf).collect()
    total, n = check(rows, texts, tokenizer)
    assert n <= 1.02 * total / 2048 + 1


def test_op4(spark, sf, table, monkeypatch):
    monkeypatch.setattr(q, "COMMON", 1_000_000)
    got = {r.doc_id: r for r in Q["op4"](spark, sf).collect()}
    want = brute.quality_verdicts([(r.doc_id, r.text, r.lang) for r in table])
    assert {i: r.kept for i, r in got.items()} == want and 0 < sum(want.values()) < len(want)
    for r in table:
        g, w = got[r.doc_id], brute.quality_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == w and g.base_failed == (w[0] < 20 or 100 * w[4] > 30 * w[0])


def test_op5(spark, sf, texts):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op5"](spark, sf).collect()} == brute.repeated(texts)


def test_op6(spark, sf, texts):
    """Scores by weights from rounded ratios stay within 0.2% of those from exact ones."""
    got = {r.doc_id: r for r in Q["op6"](spark, sf).collect()}
    base, want = brute.base_scores(texts), brute.scores(texts)
    assert set(got) == set(base)
    for i, (held, n, known, total, score) in base.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score == pytest.approx(want[i], rel=2e-3)


def test_op8(spark, sf, texts):
    rows = Q["op8"](spark, sf).collect()
    check_shards(rows, dict(texts), 8)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)


def pages(spark, docs_rows, empty, tmp_path):
    """The corpus as a table of documents, with a few odd pages among prose of three sources and two languages."""
    rng = random.Random(3)
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "a", "b", "é")[i % 4], len(t or "")) for i, t in docs_rows]
    rows += [(500 + i, "".join(rng.choice("#$%&*<>| ") for _ in range(600)), "en", "a", 600) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_pipeline_equals_plain_stages(spark, docs_rows, empty, tmp_path, monkeypatch, tokenizer):
    """run() on a small table: what each plain stage leaves, taken as often as the plain mix says, in pieces of the plain tokenizer."""
    import corpus_pipeline

    monkeypatch.setattr(q, "COMMON", 1_000_000)
    rows = pages(spark, docs_rows, empty, tmp_path)
    kept = brute.quality_verdicts([r[:3] for r in rows])
    left = [r for r in rows if kept[r[0]]]
    one = brute.near_duplicates([r[:2] for r in left], 5, 80)
    left = [r for r in left if one[r[0]][2]]
    text = brute.kept_texts([r[:2] for r in left])
    left = [(r[0], text[r[0]], r[3]) for r in left if brute.words(text[r[0]])]
    times = brute.mix_times(left)
    assert 0 < len(left) < len(rows) and len(set(times.values())) > 1
    want = Counter()
    for i, t, _ in left:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += times[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == +want
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_very_long_texts(spark, tokenizer):
    """Longer than a slice of text: counts, ids, repeated strings and scores of the whole."""
    from flowsieve.llm import kernels, lm, packing, suffix

    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(230_000))
    assert len(long) > kernels.SLICE_BYTES
    rows = [(1, long, "en"), (2, "a b c " * 30, "en"), (3, "x " + long[400_000:400_500], "en"), (6, long[:300], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [r[:2] for r in rows]
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.quality(df).collect()} == {i: brute.quality_counts(t) for i, t in texts}
    check(packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect(), texts, tokenizer)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(df).collect()} == brute.repeated(texts)
    got, base = {r.doc_id: r for r in lm.score(df).collect()}, brute.base_scores(texts)
    assert all((got[i].n_tokens, got[i].n_known) == (n, known) and got[i].base_score == pytest.approx(s, rel=1e-9) for i, (_, n, known, _, s) in base.items())


def test_anchors_of_a_text_in_blocks():
    from flowsieve.llm.suffix import anchors

    data = np.random.default_rng(4).integers(97, 101, 9000, dtype=np.uint8)
    offs = np.array([0, 50, 4000, 4000, 9000])
    whole = anchors(data, offs, 100)
    parts = anchors(data, offs, 100, 1000)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_crowds_of_equal_rows_are_dealt_out(spark):
    """Thousands of equal rows: groups stay near their size, every row is packed."""
    from pyspark.sql import functions as F

    from flowsieve.llm import packing

    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same short text").alias("text"))
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), group=200)
    sizes = Counter(r.sequence_id % 15 for r in rows.collect())
    assert sum(sizes.values()) == 3000 and len(sizes) == 15 and max(sizes.values()) < 300


def test_columns_with_the_operators_names(spark):
    """Extra columns under names that operators use inside come back as they were."""
    from flowsieve.llm import stages

    names = ["id", "__id", "_id", "spans", "row", "held", "own_id", "bound", "target", "source_size", "nth", "ref", "name", "__hit", "__slot", "__row", "__n", "part", "bucket", "length", "z", "h", "kept"]
    rng = random.Random(11)
    prose = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    shared = prose(40)
    rows = [(i, prose(60) + " " + shared, "en", "ab"[i % 2], 1, *(f"{c}{i}" for c in names)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for stage in (stages.quality_stage, stages.near_duplicate_stage, stages.passage_stage, stages.mixing_stage):
        got = stage(df)
        assert got.columns == df.columns
        found = got.collect()
        assert found and all(tuple(r)[5:] == tuple(f"{c}{r.doc_id}" for c in names) for r in found)
