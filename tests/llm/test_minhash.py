import random

import numpy as np

from flowsieve.llm.components import components
from flowsieve.llm import minhash
from flowsieve.llm.minhash import near_duplicates

from . import brute


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_all_pairs(docs, docs_rows):
    for size in (4, 5):
        assert rows(near_duplicates(docs, size)) == brute.near_duplicates(docs_rows, size, 80)


def test_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are linked, ends are not, and all are one component; beside it a group that shares less."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(90):
        base = list(base)
        base[rng.randrange(100)] = f"n{i}"
        texts.append(" ".join(base))
    other = [f"v{i}" for i in range(100)]
    for i in range(60):
        w = list(other)
        for j in range(3):
            w[(i * 7 + j * 31) % 100] = f"m{i}_{j}"
        texts.append(" ".join(w))
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert rows(near_duplicates(df, 4)) == brute.near_duplicates(data, 4, 80)


def test_nulls_repeats_and_nothing(spark, odd_ids, empty, docs_rows):
    got = near_duplicates(odd_ids, 4).collect()
    assert len(got) == 28
    null = next(r for r in got if r.doc_id is None)
    assert null.component_id is None and null.kept
    want = brute.near_duplicates(docs_rows[:25], 4, 80)
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert near_duplicates(empty).count() == 0


def test_components_in_many_tasks(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000, x) for x in range(1001, 1200)] + [(x, x + 1) for x in range(2000, 2120)]
    want = brute.components(links, {x for p in links for x in p})
    df = spark.createDataFrame([*links, (None, 5), (7, 7)], "a long, b long")
    for per_task in (50, 1_000_000):
        got = {r.node: r.component for r in components(df, per_task).collect()}
        assert {k: v for k, v in got.items() if k in want} == want
    assert components(df.limit(0)).count() == 0


def test_common_prefixes():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [9, 2, 3, 4], [1, 2, 9, 4]], ">u4").view(np.uint8).reshape(4, 16)
    assert minhash.common_prefix(a, a[[0, 0, 0, 0]]).tolist() == [4, 4, 0, 2]


def test_prefixes_get_longer_in_a_crowd(spark, monkeypatch):
    """Pages of one template, alike but not linked, with some near copies among them: regions deepen, and no link is lost."""
    rng = random.Random(7)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = template + [f"own{i}_{j}" for j in range(50)]
        texts.append(" ".join(w))
        if i % 5 == 0:
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute.near_duplicates(data, 4, 80)
    assert len({c for _, c, _ in want.values()}) == 150
    lengths = []
    regions = minhash._regions
    monkeypatch.setattr(minhash, "_regions", lambda trees, depth, length: lengths.append(length) or regions(trees, depth, length))
    for probes in (4096, 10):
        monkeypatch.setattr(minhash, "PROBES", probes)
        lengths.clear()
        assert rows(near_duplicates(df, 4)) == want
        assert lengths == ([4] if probes > 10 else list(range(4, max(lengths) + 1))) and max(lengths) >= (4 if probes > 10 else 7)


def test_a_very_long_text(spark):
    """Longer than a slice and a block of hashes: sets of whole texts, and a copy of it is linked."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(100_000)}" for _ in range(400_000))
    data = [(1, long), (2, "a b c d e f"), (3, long + " x"), (4, long[::-1])]
    assert len(long) > 2 << 20
    assert rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4)) == brute.near_duplicates(data, 4, 80)


def test_a_large_cluster_without_links_is_cut_by_rare_shingles(spark, monkeypatch):
    """Pages alike at about 0.7, a few of them linked: the same links by blocks of the whole cluster and by rare shingles, which leave out most pages."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(160)]
    texts = []
    for i in range(80):
        w = template + [f"own{i}_{j}" for j in range(30)]
        texts.append(" ".join(w))
        if i % 8 == 0:
            w = list(w)
            w[rng.randrange(150)] = "changed"
            texts.append(" ".join(w))
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute.near_duplicates(data, 4, 80)
    seen = []
    rare = minhash._by_rare_shingles
    monkeypatch.setattr(minhash, "_by_rare_shingles", lambda *a: seen.append(rare(*a)) or seen[-1])
    for probes in (4096, 10):
        monkeypatch.setattr(minhash, "PROBES", probes)
        seen.clear()
        assert rows(near_duplicates(df, 4)) == want
        assert len(seen) == (probes == 10)
    assert seen[0].select("rep").distinct().count() <= 25
    assert len({c for _, c, _ in want.values()}) == 80
