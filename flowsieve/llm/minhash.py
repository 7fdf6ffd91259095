"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every tree of the forest is a sorted order of the distinct documents by its own run of signature
values. What two neighbours share is their longest common prefix; those that share `least` leading values or more are candidates, and a document's best
neighbour is the one with which it shares most values over all orders. Candidates are confirmed on full shingle sets, and links form components.

A crowded region of an order holds more pairs than neighbours. Pairs inside one component no longer matter, so that only regions with several components are
looked at again. How deep a region's prefix is adapts to its crowd: it has `least` values, and one more as long as more than PROBES documents in it lie outside
the region's largest component, so that what is dealt out grows with the documents and not with the square of a crowd. Beyond a tree's own values the prefix goes on with
the next tree's. In regions, signatures say in blocks which components may be linked; these form clusters. In a cluster every document outside the
largest component is held against all of its documents, in blocks, by an inverted index over full shingle sets. A cluster with more than PROBES documents outside its largest
component is first cut by rare shingles: only documents that share one of their rarest are held against each other, which loses no pair.

What can be missed: a pair of similarity 0.8 shares 4 leading values in none of 20 orders with probability 3e-5, 6 with 2e-3, 8 with 3e-2 (the last two matter in regions
with PROBES unlinked documents only, and a pair may be neighbours all the same); signatures of a pair at 0.8 agree on less than the share asked for
with probability 1e-9.

Equal shingle sets are one node from the start (a 128-bit digest of the set), so that copies cost one row each.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, likely_ids, with_text_bytes
from .components import components
from .kernels import LOWER, mix, shingle_sets, slices, string_bytes

#: 20 orders of up to 6 values; two documents of similarity 0.8 agree on 4 leading values in one of them with probability 0.99997.
TREES, DEPTH, LEAST = 20, 6, 4
BLOCK = 512
#: Documents outside a region's largest component from which on its prefix gets longer; the longest prefix.
PROBES, DEEPEST = 4096, 12
#: Standard errors of the signature's estimate below the similarity at which a pair is no longer confirmed.
SLACK = 6.0


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(811)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    mult, add = _family(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * mult + add).min(0), out=out)
    return out


def _sign(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch):
                sets = shingle_sets(data, offs, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s, n).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp", "sig"],
                )

    return run


def _orders(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sigs = string_bytes(batch.column(1).cast(pa.binary()))[0].reshape(n, trees, 4 * depth)
            for at in range(0, n, 4096):
                keys = sigs[at : at + 4096]
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), m)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), m * trees, [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary()),
                        pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[at : at + 4096], trees)),
                    ],
                    ["tree", "key", "rep"],
                )

    return run


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading values of four bytes that the rows of two arrays share."""
    same = (a == b).reshape(len(a), -1, 4).all(2)
    return np.logical_and.accumulate(same, 1).sum(1)


def _neighbours(least: int, edges: bool):
    """Adjacent rows of a sorted run whose longest common prefix has `least` values or more, with its length; edges: also the run's first and last row,
    for the joints between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def out(a, b, lcp, tree=None, key=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lcp, pa.int32()), pa.array(tree if tree is not None else [None] * n, pa.int32()), pa.array(key if key is not None else [None] * n, pa.binary())],
                ["a", "b", "lcp", "tree", "key"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            keys = string_bytes(batch.column(1))[0].reshape(batch.num_rows, -1)
            if last is None:
                if edges:
                    yield out([rep[0]], [None], [0], [tree[0]], [keys[0].tobytes()])
            else:
                tree, rep, keys = np.append(last[0], tree), np.append(last[1], rep), np.concatenate((last[2], keys))
            lcp = np.where(tree[1:] == tree[:-1], common_prefix(keys[1:], keys[:-1]), 0)
            near = lcp >= least
            a, b = rep[:-1][near], rep[1:][near]
            yield out(np.minimum(a, b), np.maximum(a, b), lcp[near])
            last = tree[-1:], rep[-1:], keys[-1:].copy()
        if edges and last is not None:
            yield out([last[1][0]], [None], [0], [last[0][0]], [last[2][0].tobytes()])

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in lower case, compressed."""
    press = zstandard.ZstdCompressor(1)
    for batch in batches:
        for part, data, offs in slices(batch):
            data = LOWER[data]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])], pa.binary())], ["doc_id", "z"])


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdDecompressor(), OrderedDict()

        def shingles(i: int, z: bytes) -> np.ndarray:
            key = i, len(z)
            if key not in known:
                data = np.frombuffer(press.decompress(z), np.uint8)
                known[key] = shingle_sets(data, np.array([0, len(data)]), size)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(key)
            return known[key]

        for batch in batches:
            a, za, b, zb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                x, y = shingles(a[i], za[i]), shingles(b[i], zb[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep := pa.array(keep, pa.bool_())), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    return run


def _regions(trees: int, depth: int, length: int):
    """Rows (rep, sig, component[, tree]) to the region of each document in each tree, or in the tree given: the hash of its first `length` values, counted on
    through the trees that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sigs = np.frombuffer(string_bytes(batch.column(1).cast(pa.binary()))[0].tobytes(), ">u4").reshape(n, trees * depth).astype(np.uint64)
            rep, component = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if batch.num_columns > 3:
                row, tree = np.arange(n), batch.column(3).to_numpy().astype(np.int64)
            else:
                row, tree = np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n)
            region = mix(tree.astype(np.uint64) + np.uint64(1))
            for i in range(length):
                region = mix(region + sigs[row, (tree * depth + i) % (trees * depth)] * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(tree.astype(np.int32)), pa.array(rep[row]), pa.array(component[row])], ["region", "tree", "rep", "component"])

    return run


def _short(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = string_bytes(batch.column(1).cast(pa.binary()))[0].reshape(batch.num_rows, trees * depth, 4)[:, :, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in low], pa.binary())], ["rep", "low"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """Rows (key, mb, pb, probe, ...) in order of the first three: settle(probes, members) gives pairs for each group."""
    at, probes, members = None, [], []

    def done():
        if probes and members:
            pairs = settle(probes, members)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != at:
                yield from done()
                at, probes, members = row[:3], [], []
            (probes if row[3] else members).append(row[4:])
    yield from done()


def _likely(least: float):
    """Pairs of components of which a probe and a member have short signatures that agree on a share `least`."""

    def settle(probes: list, members: list) -> list[tuple[int, int]]:
        comps = np.array([m[1] for m in members])
        low = np.frombuffer(b"".join(m[2] for m in members), np.uint8).reshape(len(members), -1)
        pairs, known = set(), {}
        for _, comp, sig in probes:
            near = ((low == np.frombuffer(sig, np.uint8)).sum(1) >= least * low.shape[1]) & (comps != comp)
            if near.any():
                pairs.update((min(comp, c), max(comp, c)) for c in np.unique(comps[near]).tolist())
        out = []
        for a, b in sorted(pairs):  # a spanning forest of them says as much
            while a in known:
                a = known[a]
            while b in known:
                b = known[b]
            if a != b:
                known[max(a, b)] = min(a, b)
                out.append((a, b))
        return out

    return lambda batches: _groups(batches, settle)


def _exact(size: int, percent: int):
    """Links of probes to members of other components, as many as it takes to join the components of a block: shared shingles are
    counted by an inverted index over the block's members."""

    def settle_with(unpress):
        def shingles(z: bytes) -> np.ndarray:
            data = np.frombuffer(unpress.decompress(z), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), size)[0]

        def settle(probes: list, members: list) -> list[tuple[int, int]]:
            sets = [shingles(m[2]) for m in members]
            sizes = np.array([len(s) for s in sets])
            keys = np.concatenate(sets)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], np.repeat(np.arange(len(sets)), sizes)[order]
            kinds, first, count = np.unique(keys, return_index=True, return_counts=True)
            reps, comps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
            links, joined = [], {}

            def root(c: int) -> int:
                while c in joined:
                    c = joined[c]
                return c

            for rep, comp, z in probes:
                mine = shingles(z)
                at = np.searchsorted(kinds, mine)
                at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == mine)]
                n = count[at]
                posts = np.arange(int(n.sum())) + np.repeat(first[at] - (np.cumsum(n) - n), n)
                both = np.bincount(owner[posts], minlength=len(sets))
                hit = np.flatnonzero((100 * both >= percent * (len(mine) + sizes - both)) & (comps != comp))
                for i in hit[np.unique(comps[hit], return_index=True)[1]].tolist():
                    x, y = root(comp), root(int(comps[i]))
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        links.append((min(rep, int(reps[i])), max(rep, int(reps[i]))))
            return links

        return settle

    return lambda batches: _groups(batches, settle_with(zstandard.ZstdDecompressor()))


def _crowds(rows: DataFrame, key: str) -> DataFrame:
    """(key, size, outside, top) of keys with several components: its documents, those outside the largest component, and that."""
    shares = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy(key).agg(F.sum("n").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("top")).where("kinds > 1")
    return mixed.select(key, "size", (F.col("size") - F.col("top.n")).alias("outside"), F.col("top.component").alias("top"))


def _settled_regions(marked: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(region, rep, component) of the regions that hold several components, each as deep as its crowd asks for."""
    kind = "region long, tree int, rep long, component long"
    rows, done, length = marked.mapInArrow(_regions(trees, depth, least), kind), [], least
    while True:
        crowds = cut(_crowds(rows, "region"))
        over = crowds.where(F.col("outside") > PROBES) if length < min(DEEPEST, trees * depth) else crowds.limit(0)
        done.append(rows.join(crowds.join(over.select("region"), "region", "left_anti").select("region"), "region", "left_semi").select("region", "rep", "component"))
        if over.isEmpty():
            return cut(reduce(DataFrame.union, done))
        length += 1
        deeper = rows.join(over.select("region"), "region", "left_semi").select("rep", "tree").join(marked, "rep").select("rep", "sig", "component", "tree")
        rows = cut(deeper.mapInArrow(_regions(trees, depth, length), kind))


def _deal(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows (key, rep, component, payload) of keys with several components, as blocks: what lies outside a key's largest component, the
    probes, against all of its rows, BLOCK by BLOCK at most in expectation."""
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = _crowds(rows, key).select(F.col(key).alias("__key"), blocks(F.col("size")).alias("mbs"), blocks(F.col("outside")).alias("pbs"), F.col("top").alias("__top"))
    rows = rows.join(mixed, F.col(key) == F.col("__key"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select(key, place("mbs").alias("mb"), every("pbs").alias("pb"), F.lit(False).alias("probe"), "rep", "component", payload)
    probes = rows.where("component <> __top").select(key, every("mbs").alias("mb"), place("pbs").alias("pb"), F.lit(True).alias("probe"), "rep", "component", payload)
    return members.union(probes).repartition(key, "mb", "pb").sortWithinPartitions(key, "mb", "pb")


def _sets(size: int):
    """Rows (cluster, rep, component, z) with the text's shingles instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = [np.frombuffer(press.decompress(z), np.uint8) for z in part.column(3).to_pylist()]
                sets = [shingle_sets(d, np.array([0, len(d)]), size)[0].view(np.int64) for d in data]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))], ["cluster", "rep", "component", "shingles"])

    return run


def _by_rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(cluster, rep, component, z) with a cluster for each rare shingle that documents share, instead of theirs.

    Of n shingles in an order common to all, the first that two sets of similarity t share is among the first n - ceil(t n) + 1 of each, and in the smaller set even among the
    first n - ceil(2 t n / (1 + t)) + 1. In order of frequency these are the rarest: pages of one template whose own shingles make them less alike than t meet nowhere,
    however many they are."""
    tokens = cut(texts.mapInArrow(_sets(size), "cluster long, rep long, component long, shingles array<long>")).select("cluster", "rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = cut(tokens.groupBy(F.col("cluster").alias("of"), F.col("s").alias("t")).agg(F.count("*").alias("often")))
    order = F.row_number().over(Window.partitionBy("cluster", "rep").orderBy("often", "s"))
    ranked = tokens.join(often, (F.col("cluster") == F.col("of")) & (F.col("s") == F.col("t"))).withColumn("r", order)
    first = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("often > 1")
    narrow = F.col("r") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    met = cut(first.select(F.xxhash64("cluster", "s").alias("cluster"), "rep", "component", narrow.alias("narrow")))
    mixed = cut(_crowds(met, "cluster").join(met.where("narrow").select("cluster").distinct(), "cluster", "left_semi").select("cluster"))
    return met.join(mixed, "cluster", "left_semi").join(texts.select("rep", "z"), "rep").select("cluster", "rep", "component", "z")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, trees: int = TREES, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    docs: doc_id and text; other columns are ignored. A document's set is its distinct `size`-word
    shingles in lower case (A-Z); of fewer words, the whole sequence as one. Documents with Jaccard similarity of at least
    `similarity` are linked; component_id is the smallest doc_id reachable and kept marks that document.

    A null or wordless text has an empty set, n_shingles 0, and is linked with nothing. A row with a null doc_id
    is linked with nothing and has a null component_id and kept true. Repeated rows each come back; if several rows
    share a doc_id, they share their links. Texts of any length are taken whole. An empty table gives an empty table."""
    percent = round(100 * similarity)
    n = trees * depth
    sigs = cut(with_text_bytes(docs).mapInArrow(_sign(size, n), "doc_id long, n_shingles long, fp binary, sig binary"))
    reps = sigs.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    reps = cut(reps.select("fp", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig")))

    orders = reps.select("rep", "sig").mapInArrow(_orders(trees, depth), "tree int, key binary, rep long")
    ordered = orders.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    found = cut(ordered.mapInArrow(_neighbours(least, True), "a long, b long, lcp int, tree int, key binary"))
    joints = found.where("b is null").select("tree", "key", F.col("a").alias("rep")).repartition(1).sortWithinPartitions("tree", "key", "rep")
    joints = joints.mapInArrow(_neighbours(least, False), "a long, b long, lcp int, tree int, key binary")
    pairs = found.where("b is not null").union(joints).where("a <> b").groupBy("a", "b").agg(F.sum("lcp").alias("votes"))

    # Each document's best neighbour first: one confirmed link for most documents, which leaves few pairs across components.
    ends = pairs.select(F.col("a").alias("u"), "a", "b", "votes").union(pairs.select(F.col("b").alias("u"), "a", "b", "votes"))
    first = cut(ends.groupBy("u").agg(F.min(F.struct((-F.col("votes")).alias("v"), "a", "b")).alias("best")).select("best.a", "best.b").distinct())
    ids = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    blobs = cut(likely_ids(with_text_bytes(docs), ids).mapInArrow(_compress, "doc_id long, z binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(blobs.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a").join(blobs.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
        return both.select("a", "za", "b", "zb").mapInArrow(_confirm(size, percent), "a long, b long")

    links = cut(confirmed(first))
    labels = components(links, written=True)

    # What is left: links across components. Regions that hold several say which components may be near each other,
    # and in clusters of these every document outside the largest is held against all.
    marked = cut(reps.join(ids, F.col("rep") == F.col("id"), "left_semi").join(labels, F.col("rep") == F.col("node"), "left").select("rep", "sig", F.coalesce("component", "rep").alias("component")))
    places = _settled_regions(marked, trees, depth, least)
    low = marked.select("rep", "sig").mapInArrow(_short(trees, depth), "rep long, low binary")
    share = similarity - SLACK * (similarity * (1 - similarity) / n) ** 0.5
    near = components(_deal(places.join(low, "rep"), "region", "low").mapInArrow(_likely(share), "a long, b long"))
    clusters = cut(marked.select("rep", "component").join(near.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component"))
    texts = clusters.join(blobs.select(F.col("doc_id").alias("rep"), "z"), "rep").select("cluster", "rep", "component", "z")
    large = _crowds(clusters, "cluster").where(F.col("outside") > PROBES).select("cluster")
    if not large.isEmpty():
        rare = _by_rare_shingles(cut(texts.join(large, "cluster", "left_semi")), size, percent)
        texts = texts.join(large, "cluster", "left_anti").unionByName(rare)
    links = links.union(_deal(texts, "cluster", "z").mapInArrow(_exact(size, percent), "a long, b long"))
    labels = components(links)

    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_lsh_forest(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, similarity=0.8)
