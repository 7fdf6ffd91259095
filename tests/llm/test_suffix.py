import random

import numpy as np
import pytest

from flowsieve.llm import suffix as s

from . import brute


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [3, 64])
def test_equals_all_strings(docs, docs_rows, hot):
    assert rows(s.deduplicate(docs, 100, hot)) == brute.repeated(docs_rows)


@pytest.mark.parametrize("length", [20, 37])
def test_other_lengths_and_a_common_passage(spark, length):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcd ") for _ in range(90))
    data = [(i, "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(5, 80))) + passage[rng.randrange(20) : rng.randrange(50, 90)] + "é" * rng.randrange(30)) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(s.deduplicate(df, length, 8)) == brute.repeated(data, length)


def test_every_string_holds_an_anchor_by_content():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3000, dtype=np.uint8)
    text[1500:1800] = text[200:500]
    at, _ = s.anchors(text, np.array([0, 1000, 3000]), 40)
    for p in [*range(0, 961, 7), *range(1000, 2961, 7)]:
        assert ((at >= p) & (at <= p + 20)).any()
    first, second = (set(a - p for a in at if p <= a <= p + 20) for p in (300, 1600))
    assert first == second


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            r = sorted(bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randrange(1, 40)))
            lcp, tail = s.front_code(r)
            assert s.front_decode(lcp, tail, 9) == r
            runs.append((r, lcp.tolist()))
        order, shared = s.merge_runs(runs)
        out = [runs[r][0][i] for r, i in order]
        assert out == sorted(x for r, _ in runs for x in r)
        for a, b, n in zip(out, out[1:], shared[1:]):
            assert n == next((i for i in range(9) if a[i] != b[i]), 9)


def test_texts_without_spans(docs, docs_rows):
    spans = s.repeated_spans(docs, 100)
    left = {r.doc_id: r.text for r in s.without_spans(docs, spans).collect()}
    by = {r.doc_id: r.spans for r in spans.collect()}
    assert len(left) == len(docs_rows)
    for i, t in docs_rows:
        want = None if t is None else s.kept_bytes(t.encode(), [x.asDict() for x in by.get(i, [])]).decode("utf-8", "ignore")
        assert left[i] == want


def test_nulls_repeats_and_nothing(odd_ids, empty, docs_rows):
    got = s.deduplicate(odd_ids).collect()
    want = brute.repeated(docs_rows[:25])
    assert len(got) == 28
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert next(r for r in got if r.doc_id is None).n_removed == 0
    assert s.deduplicate(empty).count() == 0
    with pytest.raises(ValueError):
        s.repeated_spans(empty, 2)
