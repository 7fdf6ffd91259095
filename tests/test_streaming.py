from pyspark.sql import functions as F

from flowsieve.operators import sketches
from flowsieve.sources import fixtures as fx
from flowsieve.streaming import jobs


def test_sketch_state_equals_batch(spark, sf, tmp_path):
    e = fx.diffuse(spark, sf).repartition(6)
    e.write.option("maxRecordsPerFile", 500).parquet(str(tmp_path / "in"))
    state = jobs.SketchState(spark, str(tmp_path / "state"), 256, 3)
    last = state.run(jobs.edge_stream(spark, str(tmp_path / "in"), e.schema, files_per_trigger=4), str(tmp_path / "cp"))
    assert last >= 1
    state.merge(spark.read.schema(e.schema).parquet(str(tmp_path / "in")).limit(0), last + 1)
    assert {tuple(r) for r in state.sketch(last + 1).collect()} == {tuple(r) for r in sketches.count_min(e, 256, 3).collect()}
    total = state.strengths(last + 1, "src").agg(F.sum("s")).first()[0]
    assert total == e.agg(F.sum("weight")).first()[0]


def test_sketch_state_folds_and_replays(spark, tmp_path):
    """Fractions, a replay across a fold, and old versions removed."""
    state = jobs.SketchState(spark, str(tmp_path / "state"), 64, 2, fold=2)
    part = lambda b: spark.createDataFrame([(b % 3, "x", 0.5 + b), (7, "y", 0.25)], "src long, dst string, weight double")
    coded = lambda b: part(b).withColumn("dst", F.ascii("dst").cast("long"))
    for b in (0, 1, 2, 3, 3, 4, 5, 5, 6):
        state.merge(coded(b), b)
    for last in (4, 5, 6):
        got = {r.label: (r.s, r.n) for r in state.strengths(last, "src").collect()}
        want = {}
        for b in range(last + 1):
            for label, w in ((str(b % 3), 0.5 + b), ("7", 0.25)):
                s, n = want.get(label, (0.0, 0))
                want[label] = (s + w, n + 1)
        assert got == want
    every = coded(0)
    for b in range(1, 7):
        every = every.unionByName(coded(b))
    assert {tuple(r) for r in state.sketch(6).collect()} == {tuple(r) for r in sketches.count_min(every, 64, 2).collect()}
    assert len(list((tmp_path / "state" / "src" / "base").glob("0*"))) <= 2


def test_late_events_are_dropped(spark, tmp_path):
    """An event behind the watermark of the batch before no longer counts; one within the allowed delay does."""
    schema = "ts timestamp, key string, weight long"
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([("2024-01-01 10:00:00", "a", 1)], [("2024-01-03 10:00:00", "a", 2)], [("2024-01-03 10:01:00", "a", 32)], [("2024-01-01 11:00:00", "a", 4), ("2024-01-03 09:30:00", "a", 8)], [("2024-01-09 00:00:00", "a", 16)])):
        df = spark.createDataFrame(rows, "ts string, key string, weight long").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{i}"))
    import shutil
    import time

    for i in range(5):
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
            time.sleep(0.05)
    stream = jobs.edge_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    out = jobs.collect_stream(jobs.windowed_totals(stream, keys=("key",)), "late_events", "append")
    assert {(str(r.window_start)[:10], r.records, r.weight) for r in out.collect()} == {("2024-01-01", 1, 1), ("2024-01-03", 3, 42)}
