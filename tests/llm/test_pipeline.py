import random
from collections import Counter

import pytest

from flowsieve.llm import mixing, queries, stages

from ..oracle import same
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    same(spark, sf, name, queries.QUERIES, queries.ORACLE_SQL)


def test_stages_decide(spark, sf, docs, docs_rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "suffix_dedup", "source_mixing", "packing"]
    near = {r.doc_id for r in stages.near_duplicate_stage(docs).collect()}
    assert near == {i for i, (_, _, kept) in brute.near_duplicates(docs_rows, 5, 80).items() if kept}
    left = stages.passage_stage(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert all(r.n_chars == len(r.text) and brute.words(r.text) for r in left.collect())
    mixed = stages.mixing_stage(docs)
    assert mixed.columns == docs.columns
    kept = stages.quality_stage(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_whole_run(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_on_nothing_and_odd_rows(empty, odd_ids):
    for stage in (stages.quality_stage, stages.near_duplicate_stage, stages.passage_stage, stages.mixing_stage):
        assert stage(empty).count() == 0
        assert stage(odd_ids).columns == odd_ids.columns


def test_verdicts_act_on_rows(spark, empty):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    prose = lambda k=60: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(40)
    near = prose(200)
    texts = [(i, prose()) for i in range(20)]
    odd = [(None, prose()), (None, prose()), (3, prose()), (4, "too short")]
    copies = [(7, near), (None, near), (7, near + " end"), (8, near)]
    cut = [(30, passage + " " + prose(9)), (30, prose(9) + " " + passage), (None, prose(9) + " " + passage)]
    rows = [(i, t, "en", "ab"[n % 2], len(t), "x", 7, "y", "z") for n, (i, t) in enumerate(texts + odd + copies + cut)]
    docs = spark.createDataFrame(rows, empty.schema).repartition(3)
    names = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = Counter((r[0], r[1]) for r in rows)
    assert names(stages.quality_stage(docs)) == every - Counter([(4, "too short")])
    kept = names(stages.near_duplicate_stage(docs))
    assert kept in (every - Counter(copies) + Counter([c]) for c in (copies[0], copies[2]))
    left = names(stages.passage_stage(docs.where("doc_id = 30 or doc_id is null and length(text) < 400")))
    assert sum(n for (_, t), n in left.items() if passage in t) == 1 and sum(left.values()) == 5
    times = Counter({(r.doc_id, r.source): r.repeats for r in mixing.mix(docs).collect()})
    mixed = Counter(tuple(r) for r in stages.mixing_stage(docs).collect())
    assert mixed == Counter({r: times[r[0], r[3]] for r in rows if times[r[0], r[3]]})


def test_mixing_takes_rows_not_ids(spark, empty):
    """Repeated, shared and null ids: as many rows as taken, no more; names of the operator's own columns don't matter."""
    from flowsieve.llm.mixing import mix, mixed

    rows = [(i % 40 if i % 9 else None, "w " * (i % 11), "en", ("a", "b", None)[i % 3], i, "x", 7, "y", "z") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:20], empty.schema).withColumnRenamed("rep", "bound").withColumnRenamed("size", "source_size")
    times = {(r.doc_id, r.source): r.repeats for r in mix(docs).collect()}
    want = Counter()
    for r in rows + rows[:20]:
        want[r] += times[r[0], r[3]]
    assert Counter(tuple(r) for r in mixed(docs).collect()) == +want


def test_sources_beyond_the_broadcast_are_joined(spark, docs, monkeypatch):
    from flowsieve.llm import mixing as m

    whole = sorted(tuple(r) for r in m.mix(docs).select("doc_id", "taken").collect())
    kept = sorted(r.doc_id for r in m.mixed(docs).collect())
    monkeypatch.setattr(m, "MOST_SOURCES", 2)
    assert sorted(tuple(r) for r in m.mix(docs).select("doc_id", "taken").collect()) == whole
    assert sorted(r.doc_id for r in m.mixed(docs).collect()) == kept
