import zlib
from collections import defaultdict

import pytest

from flowsieve.llm import mixing as m, sharding as sh

from . import brute


def check_shards(rows, texts, shards, slack=0.05):
    """Sizes, slots without gaps, groups whole unless they exceed a shard, sizes near equal."""
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size, slots, where, group = defaultdict(int), defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.tokens, r.text_crc32) == (len(b) + 1, len(brute.words(texts[r.doc_id])), zlib.crc32(b)) and 0 <= r["shard"] < shards
        size[r["shard"]] += r["size"]
        group[b] += r["size"]
        slots[r["shard"]].append(r.slot)
        where[b].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / shards
    assert all(len(s) == 1 or group[t] > share for t, s in where.items())
    largest = max([r["size"] for r in rows] + [min(n, share) for n in group.values()])
    assert max(size.values()) - min(size[i] for i in range(shards)) <= largest + slack * share
    return size, slots


def test_shards_balance_and_keep_groups(spark, docs, docs_rows):
    """A group of a third of all rows but few bytes stays whole."""
    big = spark.createDataFrame([(1000 + i, f"text number {i} " * (i % 7 + 1)) for i in range(900)] + [(5000 + i, "same text") for i in range(450)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in big.collect()}
    size, slots = check_shards(sh.shard(big, 8, cell=200).collect(), texts, 8)
    small = sh.shard(big.where("doc_id < 5000"), 8, cell=200).collect()
    _, slots = check_shards(small, {i: t for i, t in texts.items() if i < 5000}, 8)
    assert max(map(len, slots.values())) <= 1.3 * len(small) / 8


def test_large_groups_are_split_no_more_than_needed(spark):
    rows = [(i, "the same long text " * 20) for i in range(400)] + [(1000 + i, f"other {i} " * (5 + i % 50)) for i in range(300)]
    got = sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, cell=64).collect()
    check_shards(got, dict(rows), 4, 0.25)


def test_levels_of_bins(spark):
    """Many cells, few bins on the driver: three levels give whole groups and near equal sizes too."""
    rows = [(i, f"w{i % 1500} " * (1 + i % 1500 * 7 % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size, slots = check_shards(sh.shard(df, 4, cell=10, on_driver=30).collect(), dict(rows), 4, 0.1)
    assert max(map(len, slots.values())) <= 1.2 * len(rows) / 4


def test_shard_odd_rows(odd_ids, empty):
    assert sh.shard(odd_ids, 3).count() == 28 and sh.shard(empty).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / w > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else weight[s] * rest / w for s in names}
        full |= over


def check_mix(rows, data):
    size = {i: len(brute.words(t)) for i, t, _ in data}
    sizes = defaultdict(int)
    for i, t, s in data:
        sizes[s] += size[i]
    goal = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= max([size[i] for i, _, x in data if x == s]) / 2 + 1e-9


def test_mix_meets_targets_and_agrees(docs, docs_rows):
    data = [(i, t, (None, "a", "b", "é")[i % 4]) for i, t in docs_rows]
    rows = m.mix(docs).collect()
    assert len(rows) == len(data)
    check_mix(rows, data)
    again = m.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_small_sources_and_a_hot_one(spark):
    data = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(1000, None, "empty"), (1001, "", "empty"), (1002, "x y", None)]
    check_mix(m.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect(), data)


def test_budgets_are_nested(spark):
    rows = spark.createDataFrame([("s", i * 7919 % (1 << 20) << 40, 3 + i % 5) for i in range(500)], "source string, h long, size long")
    bounds = [m.thresholds(rows, spark.createDataFrame([("s", float(b))], "source string, rest double"), bits=4).first().bound for b in (0, 10, 300, 1200, 1e9)]
    assert bounds == sorted(bounds) and bounds[0] == 0 and bounds[-1] == 1 << 60


def test_mix_odd_rows(odd_ids, empty):
    assert m.mix(odd_ids).count() == 28 and m.mix(empty).count() == 0
