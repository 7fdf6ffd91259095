import json
import struct

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import pairs as P
from flowsieve.sources import edges as E, pcap, sinks, synthetic


def packet(i, size=60, order="<"):
    body = bytearray(max(size, 34))
    body[14] = 0x45
    body[26:30], body[30:34] = struct.pack(">I", 10 + i), struct.pack(">I", 200 + i % 5)
    return struct.pack(order + "IIII", 0, 0, size, size + 7) + bytes(body[:size])


def capture(sizes, order="<"):
    magic = {"<": b"\xd4\xc3\xb2\xa1", ">": b"\xa1\xb2\xc3\xd4"}[order]
    return magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1) + b"".join(packet(i, n, order) for i, n in enumerate(sizes))


@pytest.fixture
def pcap_df(spark, tmp_path):
    pcap.register(spark)

    def read(data, name="x.pcap", **options):
        (tmp_path / name).write_bytes(data)
        return spark.read.format("pcap").options(**options).load(str(tmp_path / name)).orderBy("seq").collect()

    return read


@pytest.mark.parametrize("order", "<>")
def test_uniform_capture_splits(pcap_df, order):
    rows = pcap_df(capture([60] * 50, order), split="800")
    assert [(r.seq, r.src, r.dst, r.weight) for r in rows] == [(i, 10 + i, 200 + i % 5, 67) for i in range(50)]


def test_truncated_varying_limited_and_bad(pcap_df):
    assert len(pcap_df(capture([60] * 50)[:-30])) == 49
    assert [r.weight for r in pcap_df(capture([60, 74] * 100))] == [67, 81] * 100
    assert len(pcap_df(capture([60] * 200), limit="120")) == 120
    assert len(pcap_df(capture([60, 20] * 4))) == 4
    with pytest.raises(Exception, match="magic"):
        pcap_df(b"nonsense" * 10)


def test_chunked_and_zstd(pcap_df):
    data = capture([60] * 150 + [74] * 150)
    parts = [data[i : i + 997] for i in range(0, len(data), 997)]
    assert sum(len(g[0]) for g in pcap.edges(iter(parts))) == 300
    assert sum(len(g[0]) for g in pcap.edges(iter(parts), 120)) == 120
    import zstandard

    data = capture([60] * 9000)
    whole = zstandard.ZstdCompressor().compress(data)
    assert len(pcap_df(whole, "y.pcap.zst")) == 9000
    assert 0 < len(pcap_df(whole[: len(whole) * 6 // 10], "z.pcap.zst")) < 9000


def test_cleaning(spark, tmp_path):
    (tmp_path / "e.csv").write_text("src,dst,bytes,packets\na,b,5,1\na,b,x,1\na,,7,1\na,c,-3,1\nb,c,NaN,1\nb,c,2.5,1\n")
    got = E.read_edges(spark, str(tmp_path / "e.csv")).collect()
    assert sorted((r.src, r.dst, r.weight) for r in got) == [("a", "b", 5.0), ("b", "c", 2.5)]
    assert E.read_edges(spark, str(tmp_path / "e.csv"), "missing").count() == 5  # packets stand in
    with pytest.raises(ValueError, match="dst"):
        E.normalise(spark.createDataFrame([(1, 2)], "src long, bytes long"))


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, "x")], "src long, dst long, bytes long, note string").write.parquet(str(tmp_path / "e.parquet"))
    plan = E.read_edges(spark, str(tmp_path / "e.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bytes,0)" in plan and "note" not in plan


def test_matrix_market_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 3.5), ("c", "x", 1.0)], "src string, dst string, weight double")
    sinks.write_matrix_market(str(tmp_path / "m"), pairs, labels=str(tmp_path / "l"))
    back, rows, cols = E.read_matrix_market(spark, str(tmp_path / "m"))
    assert (rows, cols) == (3, 2)
    assert sorted(tuple(r) for r in back.collect()) == [(0, 0, 2.0), (1, 1, 3.5), (2, 0, 1.0)]
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "l_src")).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    (tmp_path / "rep.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n2 2 3\n1 1 1\n1 1 2\n2 2 3\n")
    assert sorted(tuple(r) for r in E.read_matrix_market(spark, str(tmp_path / "rep.mtx"))[0].collect()) == [(0, 0, 3.0), (1, 1, 3.0)]
    (tmp_path / "one.mtx").write_text("%%MatrixMarket matrix coordinate real general\n1 1 1\n1 1 1\n")
    assert [tuple(r) for r in E.read_matrix_market(spark, str(tmp_path / "one.mtx"))[0].collect()] == [(0, 0, 1.0)]


def test_sinks(spark, tmp_path):
    e = E.normalise(synthetic.make_edges(spark, 500, 32, 32))
    for path in sinks.save_analysis(str(tmp_path / "out"), P.aggregate_pairs(e), 5):
        assert spark.read.option("header", True).csv(path).count() > 0
    m = json.loads(sinks.manifest(e, "synthetic", b"abc"))
    assert m["records"] == 500 and m["sha256"].startswith("ba7816bf")


def test_generators(spark):
    for regime in synthetic.REGIMES:
        a = synthetic.make_edges(spark, 1000, 100, 64, regime)
        row = a.agg(F.min("src"), F.max("src"), F.min("dst"), F.max("dst"), F.min("bytes"), F.count("*")).first()
        assert row[0] >= 0 and row[1] < 100 and row[2] >= 0 and row[3] < 64 and row[4] >= 1 and row[5] == 1000
        assert P.same_rows(a, synthetic.make_edges(spark, 1000, 100, 64, regime).repartition(3))
    c = synthetic.make_controlled_edges(spark, 5000, 256, 256, target_nnz=800, skew=0.4)
    assert c.select("src", "dst").distinct().count() == 800
    assert synthetic.make_edges(spark, 3, 4, 4, strings=True).first().src.startswith("s0000")
    with pytest.raises(ValueError):
        synthetic.make_edges(spark, 1, 1, 1, "odd")


def test_a_cell_that_reads_like_the_size_line(spark, tmp_path):
    """In one partition and in several, in one file and in a folder of parts."""
    cells = [(i, j, i + j) for i in range(1, 4) for j in range(1, 4)]
    text = "%%MatrixMarket matrix coordinate real general\n% c\n3 3 6\n" + "".join(f"{i} {j} {w}\n" for i, j, w in cells)
    (tmp_path / "a.mtx").write_text(text)
    head, tail = text.split("3 1 4\n")
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "part-0").write_text(head)
    (tmp_path / "parts" / "part-1").write_text("3 1 4\n" + tail)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path in ("a.mtx", "parts"):
            got, rows, cols = E.read_matrix_market(spark, str(tmp_path / path))
            assert (rows, cols) == (3, 3)
            assert sorted(tuple(r) for r in got.collect()) == [(i - 1, j - 1, float(w)) for i, j, w in cells]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 1\n2 1 5\n")
    assert sorted(tuple(r) for r in E.read_matrix_market(spark, str(tmp_path / "s.mtx"))[0].collect()) == [(0, 0, 1.0), (0, 1, 5.0), (1, 0, 5.0)]


def test_captures_that_change_their_size(spark, tmp_path):
    """Before and after the change, at a range's border, and with a cut end: ranges first, then one task; the same rows as by one task alone."""
    for change, cut in ((700, 0), (640, 0), (999, 7), (10_000, 5), (0, 0)):
        rows = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") * 7).alias("src"), (F.col("id") % 13).alias("dst"), (F.col("id") + 60).alias("weight"), F.when(F.col("id") >= change, F.col("id") % 5).otherwise(0).alias("payload"))
        path = str(tmp_path / f"c{change}.pcap")
        sinks.write_pcap(path, rows)
        if cut:
            data = open(path, "rb").read()
            open(path, "wb").write(data[:-cut])
        got = sorted(tuple(r) for r in pcap.read_pcap(spark, path, split=3200).collect())
        assert got == [(i, i * 7, i % 13, i + 60) for i in range(1000 - bool(cut))]
        info = pcap.provenance(spark, path)
        assert info["packets_parsed"] == len(got) and info["byte_order"] == "<" and info["linktype"] == 1 and info["ip_offset"] == 14 and info["ipv4_fraction_probe"] == 1.0
        assert info["parser_path"] == ("struct" if change == 0 else "numpy" if change >= 999 else "numpy_then_struct")
        assert len(sinks.file_digest(spark, path)) == 64
