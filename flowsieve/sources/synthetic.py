"""Synthetic edges by integer arithmetic on row numbers: any size, no state, the same rows for the same seed whatever the partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGIMES = ("uniform", "hotspot", "community", "scanner")
#: Fixed: other names of the regimes.
ALIASES = {"uniform_sparse": "uniform", "hotspot_zipf": "hotspot", "community_bursty": "community", "scanner_fanout": "scanner"}
#: Fixed: least labels of a side and the powers of the number of edges that sources and destinations grow by.
SHAPES = {"hotspot": (512, 0.50, 0.50), "community": (2048, 0.58, 0.58), "scanner": (4096, 0.62, 0.68), "uniform": (8192, 0.72, 0.72)}
#: Fixed shape parameters of the regimes.
ZIPF, LOCAL, BURST, SCAN = 1.35, 0.88, 0.08, 0.18


#: The generator's modulus: products of two numbers below it fit 63 bits, so that any SQL engine can repeat its arithmetic.
PRIME, ROUNDS = 2147483647, 3


def stream(seed: int, salt: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each round of a stream of numbers."""
    x, out = (seed * 1_000_003 + salt * 7_919 + 1) % PRIME, []
    for _ in range(2 * ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        out.append(x)
    return list(zip(out[::2], out[1::2]))


def uniform(seed: int, salt: int, row: str = "seq") -> Column:
    """A number in [0, 1) of a row: quadratic rounds modulo PRIME."""
    x = (F.col(row) % PRIME + F.expr(f"{row} div {PRIME}") * 48_271) % PRIME
    for a, b in stream(seed, salt):
        x = (x * x % PRIME + x * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME
    return x / float(PRIME)


def zipf(u: Column, n: int, power: float = ZIPF) -> Column:
    """Rank below n, with weights close to rank ** -power: the inverse of the continuous distribution."""
    e = 1.0 - power
    return F.least(F.floor(F.pow(u * (float(n + 1) ** e - 1.0) + 1.0, 1.0 / e)) - 1, F.lit(n - 1)).cast("long")


def scatter_step(n: int) -> int:
    """An odd multiplier that permutes 0 to n - 1."""
    return next(m for m in range(n // 2 * 2 + 1 if n < 3 else int(n * 0.618) | 1, 4 * n + 9, 2) if _coprime(m, n))


def _scatter(rank: Column, n: int, seed: int) -> Column:
    """Ranks spread over labels, one to one."""
    return F.pmod(rank * scatter_step(n) + F.lit(seed % max(n, 1)), F.lit(n))


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def label(code: Column, prefix: str, strings: bool) -> Column:
    return F.format_string(prefix + "%08d", code) if strings else code


def _values(df: DataFrame, seed: int, bins: int, regime: str) -> DataFrame:
    size = F.floor(F.exp(5.0 + 1.1 * F.sqrt(-2 * F.log(1 - uniform(seed, 8))) * F.cos(2 * 3.141592653589793 * uniform(seed, 9)))).cast("long")
    df = df.withColumn("bytes", F.greatest(size, F.lit(1))).withColumn("time_bin", F.floor(uniform(seed, 10) * bins).cast("int"))
    return df.withColumn("packets", F.bround(F.greatest(F.col("bytes") / 512.0, F.lit(1.0)), 3)).withColumn("regime", F.lit(regime))


def shape(regime: str, n: int) -> tuple[int, int]:
    """Sources and destinations with which a regime is benchmarked at n edges."""
    regime = ALIASES.get(regime, regime)
    if regime not in SHAPES:
        raise ValueError(f"unknown regime {regime!r}; one of {', '.join(REGIMES)}")
    least, *powers = SHAPES[regime]
    return tuple(max(least, int(n**p)) for p in powers)


def make_edges(spark: SparkSession, n: int, sources: int, destinations: int, regime: str = "hotspot", seed: int = 7, bins: int = 24, strings: bool = False) -> DataFrame:
    """seq, time_bin, src, dst, packets, bytes, regime."""
    regime = ALIASES.get(regime, regime)
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime!r}; one of {', '.join(REGIMES)}")
    u = [uniform(seed, i) for i in range(8)]
    pick = lambda x, m: F.floor(x * m).cast("long")
    src, dst = pick(u[0], sources), pick(u[1], destinations)
    if regime == "hotspot":
        src, dst = _scatter(zipf(u[0], sources), sources, seed), _scatter(zipf(u[1], destinations), destinations, seed + 1)
    elif regime == "community":
        blocks = max(1, min(16, sources, destinations))
        block = pick(u[2], blocks)
        inside = lambda m: block * (m // blocks)
        local = u[3] < LOCAL
        src = F.when(local, inside(sources) + pick(u[0], max(1, sources // blocks))).otherwise(src)
        dst = F.when(local, inside(destinations) + pick(u[1], max(1, destinations // blocks))).otherwise(dst)
        burst = u[4] < BURST
        src, dst = F.when(burst, F.lit(0)).otherwise(src), F.when(burst, pick(u[5], max(1, destinations // 64))).otherwise(dst)
    elif regime == "scanner":
        src = F.when(u[3] < SCAN, F.floor(u[4] * 3).cast("long") % sources).otherwise(src)
    df = _values(spark.range(n).withColumnRenamed("id", "seq"), seed, bins, regime)
    return df.select("seq", "time_bin", label(src.cast("long"), "s", strings).alias("src"), label(dst.cast("long"), "d", strings).alias("dst"), "packets", "bytes", "regime")


def make_controlled_edges(spark: SparkSession, n: int, sources: int, destinations: int, target_nnz: int | None = None, density: float | None = None, duplication: float | None = None, skew: float = 0.0, scanners: float = 0.0, bursts: float = 0.0, bins: int = 24, seed: int = 7) -> DataFrame:
    """make_edges' columns and target_nnz: records drawn from a pool of distinct pairs, whose number follows from one of target_nnz, density or duplication."""
    if target_nnz is None:
        target_nnz = round(density * sources * destinations) if density is not None else round(n * (1 - duplication)) if duplication is not None else n // 2
    target_nnz = max(1, min(int(target_nnz), sources * destinations, n))
    cells = sources * destinations
    slot = zipf(uniform(seed, 0), target_nnz, 1.0 + skew) if skew > 0 else F.floor(uniform(seed, 0) * target_nnz).cast("long")
    slot = F.when(F.col("seq") < min(n, target_nnz), F.col("seq")).otherwise(slot)  # each pair of the pool once, as far as records go
    cell = _scatter(slot, cells, seed)
    src, dst = F.floor(cell / destinations).cast("long"), (cell % destinations).cast("long")
    df = _values(spark.range(n).withColumnRenamed("id", "seq"), seed, bins, "controlled")
    src = F.when(uniform(seed, 3) < scanners, F.lit(0)).otherwise(src)
    bin_ = F.when(uniform(seed, 4) < bursts, F.lit(bins // 2)).otherwise(F.col("time_bin")).cast("int")
    return df.select("seq", bin_.alias("time_bin"), src.cast("long").alias("src"), dst.alias("dst"), "packets", "bytes", "regime", F.lit(target_nnz).cast("long").alias("target_nnz"))


SCENARIOS = ("volume_spike", "scan", "hotspot", "fan_in")


def make_anomaly_edges(spark: SparkSession, scenario: str, n: int = 120_000, labels: int = 4096, bins: int = 24, bad_bin: int = 17, seed: int = 59, share: float = 0.1) -> DataFrame:
    """Controlled edges with extra rows in one bin: src, dst, bytes, time_bin, seq."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; one of {', '.join(SCENARIOS)}")
    base = make_controlled_edges(spark, n, labels, labels, duplication=0.3, bins=bins, seed=seed).select("seq", "time_bin", "src", "dst", "bytes")
    extra = spark.range(n, n + int(n * share)).withColumnRenamed("id", "seq")
    any_ = lambda i: F.floor(uniform(seed + 1, i) * labels).cast("long")
    src, dst, size = {
        "volume_spike": (any_(0), any_(1), F.lit(20_000)),
        "scan": (F.lit(1), F.pmod(F.col("seq"), F.lit(labels)), F.lit(60)),
        "hotspot": (F.lit(2), F.lit(3), F.lit(5_000)),
        "fan_in": (F.pmod(F.col("seq"), F.lit(labels)), F.lit(5), F.lit(400)),
    }[scenario]
    return base.unionByName(extra.select("seq", F.lit(bad_bin).cast("int").alias("time_bin"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), size.cast("long").alias("bytes")))


def write_edges(df: DataFrame, path: str) -> None:
    """Generated edges as a Parquet (.parquet, .pq) or CSV folder."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if path.rstrip("/").endswith((".parquet", ".pq")) else writer.option("header", True).csv(path)
