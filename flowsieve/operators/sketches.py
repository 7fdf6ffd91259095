"""Mergeable heavy-hitter sketches: weighted Count-Min, dyadic Count-Min with beam descent, SpaceSaving.

Counters are long tables (row, col, w): a sketch is one grouped sum, whose partial sums are the merge. The hash is plain integer arithmetic modulo
2^31 - 1, so that any SQL engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed: the prime of the hash family and the stride of its rows' seeds.
PRIME, STRIDE = 2147483647, 104729
WIDTH, DEPTH, CAPACITY, SEED = 8192, 5, 512, 17
#: Summaries that one task merges.
FAN_IN = 8


def hash_parameters(row: int, seed: int = SEED) -> tuple[int, int, int]:
    """Multipliers and offset of a row, below the prime."""
    x = seed + row * STRIDE
    out = []
    for _ in range(3):
        x = (x * 48271 + 11) % PRIME
        out.append(x % (PRIME - 1) + 1)
    return tuple(out)


def bucket(src: Column, dst: Column, row: int, width: int, seed: int = SEED) -> Column:
    """Counter of an integer pair in a row; no product overflows 63 bits."""
    a, b, c = hash_parameters(row, seed)
    h = (F.lit(a).cast("long") * F.pmod(src.cast("long"), F.lit(PRIME)) + F.lit(b)) % PRIME
    return (F.lit(c).cast("long") * F.pmod(dst.cast("long"), F.lit(PRIME)) + h) % PRIME % width


def _rows(df: DataFrame, src: Column, dst: Column, width: int, depth: int, seed: int) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(r).alias("row"), bucket(src, dst, r, width, seed).alias("col")) for r in range(depth)))
    return df.withColumn("__cell", F.explode(cells)).select("*", "__cell.row", "__cell.col").drop("__cell")


def count_min(edges: DataFrame, width: int = WIDTH, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(row, col, w): weighted counters that aren't zero. Edges are summed by pair first, so that `depth` rows are made of each pair and not of each record."""
    pairs = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return _rows(pairs, F.col("src"), F.col("dst"), width, depth, seed).groupBy("row", "col").agg(F.sum("weight").alias("w"))


def merge_count_min(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("row", "col").agg(F.sum("w").alias("w"))


def estimate(keys: DataFrame, sketch: DataFrame, width: int = WIDTH, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """keys (src, dst) with estimated_weight, the least counter of their rows. The sketch has width * depth rows at most; it is broadcast where that is small."""
    small = width * depth <= 1 << 18
    rows = _rows(keys, F.col("src"), F.col("dst"), width, depth, seed).alias("k")
    cells = (F.broadcast(sketch) if small else sketch).select(F.col("row").alias("r"), F.col("col").alias("c"), "w")
    found = rows.join(cells, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left")
    return found.groupBy(*keys.columns).agg(F.min(F.coalesce("w", F.lit(0))).alias("estimated_weight"))


def space_saving(edges: DataFrame, capacity: int = 256) -> DataFrame:
    """(src, dst, count, error): at most `capacity` tracked pairs of integers or strings; true weight <= count <= true weight + error, error <= W / capacity.

    Tasks keep summaries of their records, pre-summed by pair; summaries are merged pair-wise by adding counts, a pair unknown to a full summary counting
    as that summary's least. A merge keeps the largest `capacity`, at every level, so that a task holds a few summaries at most."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = f"src {kinds['src']}, dst {kinds['dst']}, count double, error double, floor double, part int"

    def track(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        counts: dict = {}
        errors: dict = {}
        heap: list = []
        for frame in batches:
            for src, dst, w in zip(frame["src"], frame["dst"], frame["weight"]):
                key, w = (src, dst), float(w)
                if key in counts:
                    counts[key] += w
                elif len(counts) < capacity:
                    counts[key], errors[key] = w, 0.0
                    heapq.heappush(heap, (w, len(heap), key))
                else:
                    while True:  # a stale entry is put back with what its pair has by now: the heap stays at one entry a pair
                        least, n, old = heap[0]
                        if counts[old] == least:
                            break
                        heapq.heapreplace(heap, (counts[old], n, old))
                    del counts[old], errors[old]
                    counts[key], errors[key] = least + w, least
                    heapq.heapreplace(heap, (least + w, n, key))
        if counts:
            floor = min(counts.values()) if len(counts) >= capacity else 0.0
            yield pd.DataFrame([(s, d, c, errors[s, d], floor) for (s, d), c in counts.items()], columns=["src", "dst", "count", "error", "floor"]).assign(part=0)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        floors = frame.groupby("slot")["floor"].first()
        both = frame.groupby(["src", "dst"], sort=True).agg(count=("count", "sum"), error=("error", "sum"), known=("floor", "sum")).reset_index()
        missing = floors.sum() - both["known"]
        both["count"] += missing
        both["error"] += missing
        best = both.sort_values(["count", "src", "dst"], ascending=[False, True, True])
        floor = max(floors.sum(), best["count"].iloc[capacity] if len(best) > capacity else 0.0)
        return best.head(capacity)[["src", "dst", "count", "error"]].assign(floor=floor, part=int(frame["part"].iloc[0]))

    from .ordering import durable

    pairs = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    # As many summaries as tasks had records, each of `capacity` rows at most: how many there are is read from what was written.
    parts = durable(pairs.mapInPandas(track, schema).withColumn("part", F.spark_partition_id()))
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        parts = parts.withColumn("slot", F.col("part")).withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        parts = parts.groupBy("part").applyInPandas(merged, schema)
        last //= FAN_IN
    return parts.select("src", "dst", "count", "error")


def heavy_hitters(edges: DataFrame, capacity: int = 256) -> DataFrame:
    """(src, dst, weight) of the pairs that weigh more than a share 1 / capacity of all. A tracker of `capacity` counters holds each of them, and at most
    `capacity` pairs come to the second pass, which sums them exactly."""
    found = space_saving(edges, capacity).select("src", "dst")
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    exact = edges.join(F.broadcast(found), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return exact.join(F.broadcast(total)).where(F.col("weight") > F.col("total") / float(capacity)).drop("total")


def stream_summary(edges: DataFrame, candidates: DataFrame, sketch: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """A row of exact totals, and candidates (src, dst) ranked by sketch estimate."""
    from ..functions.stats import entropy_bits

    pairs = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    cells = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("total_weight"))
    side = lambda a, p, q: pairs.groupBy(a).agg(F.sum("weight").alias("s")).agg(F.count("*").alias(f"unique_{q}"), entropy_bits("s").alias(f"{p}_entropy_bits"))
    one = cells.join(F.broadcast(side("src", "row", "sources"))).join(F.broadcast(side("dst", "column", "destinations"))).withColumn("sketch_bytes", F.lit(width * depth * 8).cast("long"))
    one = one.join(F.broadcast(candidates.agg(F.count("*").alias("candidate_count"))))
    top = estimate(candidates.select("src", "dst"), sketch, width, depth)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("estimated_weight"), "src", "dst"))
    return one, top.withColumn("rank", rank.cast("long")).select("rank", "src", "dst", "estimated_weight")


def streaming_accuracy(exact: DataFrame, approx: DataFrame, k: int = 20) -> DataFrame:
    """One row: candidate_recall (exact top k among all candidates), topk_recall (among the k best estimates), median and largest relative error of the top k; (1, 1, 0, 0)
    without exact pairs. What is broadcast are the k exact pairs, and what is found of them."""
    top = exact.where(F.col("rank") <= k).select("src", "dst", F.col("weight").cast("double").alias("w"))
    own = approx.select("src", "dst", F.col("estimated_weight").cast("double").alias("e"), F.col("rank").alias("r")).join(F.broadcast(top.select("src", "dst")), ["src", "dst"], "left_semi")
    found = top.join(F.broadcast(own), ["src", "dst"], "left")
    error = F.coalesce(F.when(F.col("w") != 0, F.abs(F.coalesce("e", F.lit(0.0)) - F.col("w")) / F.col("w")), F.lit(0.0))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(1.0))
    return found.agg(share(F.col("r").isNotNull()).alias("candidate_recall"), share(F.coalesce(F.col("r") <= k, F.lit(False))).alias("topk_recall"), F.coalesce(F.median(error), F.lit(0.0)).alias("median_relative_error"), F.coalesce(F.max(error), F.lit(0.0)).alias("max_relative_error"))


def label_bits(edges: DataFrame) -> tuple[int, int]:
    """Bits of the largest source and destination."""
    a, b = edges.agg(F.coalesce(F.max("src"), F.lit(0)), F.coalesce(F.max("dst"), F.lit(0))).first()
    return max(int(a).bit_length(), 1), max(int(b).bit_length(), 1)


def edge_keys(edges: DataFrame, bits: tuple[int, int] | None = None) -> tuple[DataFrame, int, int]:
    """(key, weight) summed by packed key, with its bits and the destination's; an error beyond 63 bits, where keys would not fit."""
    src_bits, dst_bits = bits or label_bits(edges)
    if src_bits + dst_bits > 63:
        raise ValueError(f"packed keys need {src_bits + dst_bits} bits; 63 fit")
    key = F.shiftleft(F.col("src").cast("long"), dst_bits).bitwiseOR(F.col("dst").cast("long"))
    return edges.groupBy(key.alias("key")).agg(F.sum("weight").alias("weight")), src_bits + dst_bits, dst_bits


def dyadic_count_min(keys: DataFrame, bits: int, width: int = WIDTH, depth: int = 4, top_bits: int = 12, seed: int = 101) -> DataFrame:
    """(level, row, col, w): a weighted Count-Min over every prefix length from top_bits on."""
    first = min(top_bits, bits)
    # Every (level, row) of a key is a small number; the hash's parameters are looked up by it, so that the generated code stays small.
    hashes = [hash_parameters(r, seed + 1009 * v) for v in range(first, bits + 1) for r in range(depth)]
    names = [f"array({', '.join(f'{h[i]}L' for h in hashes)})[i]" for i in range(3)]
    cells = keys.select("key", "weight", F.explode(F.sequence(F.lit(0), F.lit(len(hashes) - 1))).alias("i"))
    cells = cells.select("weight", "i", F.expr(f"shiftrightunsigned(key, {bits - first} - i div {depth})" if bits - first else "key").alias("p"))
    h = F.expr(f"({names[0]} * (shiftrightunsigned(p, 31) % {PRIME}) + {names[1]}) % {PRIME}")
    col = (F.expr(f"{names[2]} * ((p & {PRIME}) % {PRIME})") + h) % PRIME % width
    sums = cells.groupBy("i", col.alias("col")).agg(F.sum("weight").alias("w"))
    return sums.select((F.lit(first) + F.expr(f"i div {depth}")).cast("int").alias("level"), (F.col("i") % depth).cast("int").alias("row"), "col", "w")


def _level_bucket(prefix: Column, level: int, row: int, width: int, seed: int) -> Column:
    """Prefixes hash by their high and low 31 bits."""
    return bucket(F.shiftrightunsigned(prefix, 31), prefix.bitwiseAND(F.lit(PRIME)), row, width, seed + 1009 * level)


def dyadic_heavy_hitters(sketch: DataFrame, bits: int, k: int = 20, beam: int = 4096, width: int = WIDTH, depth: int = 4, top_bits: int = 12, seed: int = 101) -> DataFrame:
    """(key, estimated_weight) of the k leaves found by descending from all short prefixes, keeping `beam` of each level; ties to the smaller prefix."""
    from .ordering import durable

    sketch = durable(sketch)
    spark = sketch.sparkSession
    first = min(top_bits, bits)
    nodes = spark.range(1 << first).select(F.col("id").alias("p"))
    for level in range(first, bits + 1):
        if level > first:
            nodes = nodes.select(F.explode(F.array(F.shiftleft(F.col("p"), 1), F.shiftleft(F.col("p"), 1) + 1)).alias("p"))
        cells = F.array(*(F.struct(F.lit(r).alias("row"), _level_bucket(F.col("p"), level, r, width, seed).alias("col")) for r in range(depth)))
        rows = nodes.select("p", F.explode(cells).alias("c")).select("p", F.col("c.row").alias("r"), F.col("c.col").alias("c"))
        counters = sketch.where(F.col("level") == level)
        found = rows.join(F.broadcast(counters) if width * depth <= 1 << 18 else counters, (F.col("r") == F.col("row")) & (F.col("c") == F.col("col")), "left")
        scored = found.groupBy("p").agg(F.min(F.coalesce("w", F.lit(0))).alias("e"))
        nodes = scored.orderBy(F.desc("e"), "p").limit(k if level == bits else beam)
        if (level - first) % 6 == 5 and level < bits:
            nodes = durable(nodes)
    return nodes.select(F.col("p").alias("key"), F.col("e").alias("estimated_weight"))


def unpack(keys: DataFrame, dst_bits: int) -> DataFrame:
    """(src, dst, ...) of packed keys, ranked by estimate."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("estimated_weight"), "key"))
    return keys.select(rank.cast("long").alias("rank"), F.shiftrightunsigned("key", dst_bits).alias("src"), F.col("key").bitwiseAND(F.lit((1 << dst_bits) - 1)).alias("dst"), "estimated_weight")


def identifiability_report(edges: DataFrame, approx: DataFrame, k: int, width: int = WIDTH, capacity: int = CAPACITY) -> DataFrame:
    """One row: strict_recall (of k, found anywhere), tie_aware_recall (the first k found whose weight reaches w_k), identifiable_core_size, identifiable_recall
    (null without a core) and identifiable. approx: rank, src, dst."""
    from .conformal import budget_threshold
    from .pairs import aggregate_pairs
    from .windows import kth_weights

    pairs = aggregate_pairs(edges)
    total = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w"))
    limits = total.join(F.broadcast(kth_weights(pairs, k)))
    found = approx.select("src", "dst", F.col("rank").alias("r"))
    top = pairs.orderBy(F.desc("weight"), "src", "dst").limit(k).join(found, ["src", "dst"], "left").join(F.broadcast(limits))
    core = (F.col("w") > 0) & ((F.col("weight") - F.coalesce("next", F.lit(0.0))) / F.col("w") > budget_threshold(width, capacity))
    exact = top.agg(F.count("r").alias("hits"), F.count(F.when(core, 1)).alias("core"), F.count(F.when(core & F.col("r").isNotNull(), 1)).alias("core_hits"))
    ties = pairs.join(found, ["src", "dst"]).join(F.broadcast(limits)).agg(F.count(F.when((F.col("r") <= k) & (F.col("kth") > 0) & (F.col("weight") >= F.col("kth")), 1)).alias("ties"))
    return exact.join(F.broadcast(ties)).select(
        (F.col("hits") / float(k)).alias("strict_recall"), F.least(F.col("ties") / float(k), F.lit(1.0)).alias("tie_aware_recall"), F.col("core").alias("identifiable_core_size"), F.when(F.col("core") > 0, F.col("core_hits") / F.col("core")).alias("identifiable_recall"), (F.col("core") > 0).alias("identifiable")
    )
