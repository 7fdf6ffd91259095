"""Quality rules by distribution divergence.

For each language the corpus itself is the reference: the share of each character class and of each of the
most common words, over all of its documents. A document is held against the reference of its language by
Jensen-Shannon distance; documents too short for a stable histogram are not judged by it. Base rules on length and
repetition come first.

Every language has a reference, however few documents it has. Limits are wider by what the reference itself may err: its
sampling error, and how far one of its documents can move it. A language of one document is left to the base rules by that,
one of thousands is held to the limits as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, free, table
from .kernels import LOWER, SPACE, Words, hash_ranges, merge_counts, mix, pack_ints, pack_sorted, repeated, slices, sum_by_doc, unpack_ints, unpack_sorted, windows

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "accented", "wide", "astral")
_CLASS = np.full(256, CLASSES.index("symbol"), np.uint8)
_CLASS[:32] = CLASSES.index("control")
_CLASS[127] = CLASSES.index("control")
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[SPACE] = CLASSES.index("space")
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = CLASSES.index("stop")
_CLASS[0xC0:0xE0] = CLASSES.index("accented")
_CLASS[0xE0:0xF0] = CLASSES.index("wide")
_CLASS[0xF0:] = CLASSES.index("astral")
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Common words of a language; hash buckets in which they are counted.
COMMON, BUCKETS = 256, 64
#: A language with fewer words than this has no reference, and the base rules decide on its documents.
LEAST_REFERENCE = 1
#: References of this many languages, the largest, go to every task; those of the others are joined to their documents. Documents without a
#: language are compared with as many references at once, and with all in turn.
MAX_LANGUAGES = 256
#: Sums of distances are computed sparsely first; what is within SLACK of the smallest is computed as it is for other documents.
SLACK = 1e-6
#: Shared words and documents that a comparison holds at once.
ENTRIES, ROWS = 1_000_000, 256
#: Documents with fewer words are not judged by divergence.
GUARD_CLASSES, GUARD_WORDS = 40, 80
MOST_CLASSES, MOST_WORDS = 0.25, 0.55


def _classes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    whole = ~_TAIL[data]
    doc = np.repeat(np.arange(n), np.diff(offs))[whole]
    return np.bincount(doc * len(CLASSES) + _CLASS[data[whole]], minlength=n * len(CLASSES)).reshape(n, -1)


def _words_of(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions of the words of some documents."""
    n = offs[ids + 1] - offs[ids]
    return np.arange(int(n.sum())) + np.repeat(offs[ids] - (np.cumsum(n) - n), n)


def _by_language(langs: list) -> list[tuple]:
    """(language, its documents) for each language."""
    names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    code = np.array([names[x] for x in langs], np.int64)
    order = np.argsort(code, kind="stable")
    return list(zip(names, np.split(order, np.searchsorted(code[order], np.arange(1, len(names))))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and word counts of one task by language; words go to buckets of their hash."""
    classes: dict[str | None, np.ndarray] = {}
    held: dict[str | None, list] = {}
    merged: dict[str | None, tuple] = {}

    def fold(lang: str | None) -> None:
        parts = held.pop(lang, [])
        if lang in merged:
            parts.append(merged[lang])
        merged[lang] = merge_counts([p[0] for p in parts], [p[1] for p in parts])

    for batch in batches:
        for part, data, offs in slices(batch):
            words = Words(data, offs)
            hashes = words.hashes(LOWER[data])
            seen = _classes(data, offs)
            for x, ids in _by_language(part.column(0).to_pylist()):
                n = words.counts[ids].astype(np.int64)
                classes[x] = classes.get(x, 0) + np.append(seen[ids].sum(0), (n.sum(), (n * n).sum()))
                held.setdefault(x, []).append(np.unique(hashes[_words_of(ids, words.offs)], return_counts=True))
                if len(held[x]) >= 8:
                    fold(x)
    for x in list(held):
        fold(x)
    for x, total in classes.items():
        rows = [(-1, b"", total.astype(np.int64).tobytes())]
        keys, counts = merged[x]
        bucket = np.searchsorted(keys, np.arange(1, BUCKETS, dtype=np.uint64) * np.uint64((1 << 64) // BUCKETS))
        for b, (k, c) in enumerate(zip(np.split(keys, bucket), np.split(counts, bucket))):
            if len(k):
                rows.append((b, pack_sorted(k), pack_ints(c.astype(np.uint32))))
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "bucket", "keys", "counts"])


def _top(common: int):
    """Sums of a bucket: its most common words, or the class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, [], []

        def done():
            if at is None:
                return
            if at[1] < 0:
                c = sum(counts)
                k = np.arange(len(c), dtype=np.uint64)
            else:
                k, c = merge_counts(keys, counts)
                best = np.lexsort((k, -c))[:common]
                k, c = k[best], c[best]
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(k), pa.string()), pa.array([at[1]] * len(k), pa.int32()), pa.array(k.view(np.int64)), pa.array(c, pa.int64())], ["lang", "bucket", "key", "n"])

        for batch in batches:
            for lang, bucket, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (lang, bucket) != at:
                    yield from done()
                    at, keys, counts = (lang, bucket), [], []
                if bucket < 0:
                    counts.append(np.frombuffer(c, np.int64))
                else:
                    keys.append(unpack_sorted(k))
                    counts.append(unpack_ints(c, np.uint32).astype(np.int64))
        yield from done()

    return run


def _reference(rows: list) -> dict:
    """Rows (bucket, key, n) of a language: class shares; hashes, ascending, and shares of the most common words, the rest last; words
    and effective documents (Kish) it was counted over."""
    classes = np.zeros(len(CLASSES) + 2)
    for bucket, key, n in rows:
        if bucket < 0:
            classes[key] = n
    top = sorted((key & (1 << 64) - 1, n) for bucket, key, n in rows if bucket >= 0)
    n_words, squares = classes[-2:]
    shares = np.array([n for _, n in top], float) / n_words
    return {
        "classes": classes[:-2] / classes[:-2].sum(),
        "keys": np.array([k for k, _ in top], np.uint64),
        "words": np.append(shares, 1 - shares.sum()),
        "n_words": n_words,
        "n_docs": n_words**2 / squares,
    }


def _references(docs: DataFrame, common: int, least: int) -> tuple[dict[str | None, dict], DataFrame | None, DataFrame | None]:
    """References of the MAX_LANGUAGES largest languages and of the documents without one (None). If there are others: a table (name, ref) of
    theirs, and one of all by name, that of None last, if a document without a language has words."""
    counted = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "lang string, bucket int, keys binary, counts binary")
    merged = cut(counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_top(common), "lang string, bucket int, key long, n long"))
    words = merged.where((F.col("bucket") < 0) & (F.col("key") == len(CLASSES))).select(F.col("lang").alias("name"), "n")
    sizes = words.where(F.col("n") >= max(least, 1))
    large = sizes.where("name is not null").orderBy(F.desc("n"), "name").limit(MAX_LANGUAGES).union(sizes.where("name is null")).select("name")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))

    def rows(names: DataFrame) -> DataFrame:
        own = merged.join(names, F.col("lang").eqNullSafe(F.col("name")))
        return own.where("bucket < 0").unionByName(own.where("bucket >= 0").withColumn("r", best).where(F.col("r") <= common).drop("r")).drop("lang")

    held: dict[str | None, list] = {}
    for r in rows(F.broadcast(large)).collect():
        held.setdefault(r["name"], []).append((r["bucket"], r["key"], r["n"]))
    refs = {x: _reference(held[x]) for x in sorted(held, key=lambda x: (x is None, x))}
    if sizes.where("name is not null").count() <= MAX_LANGUAGES:
        return refs, None, None
    every = cut(rows(sizes.select("name")).groupBy("name").agg(F.collect_list(F.struct("bucket", "key", "n")).alias("ref")))
    others = every.where("name is not null").join(F.broadcast(large), "name", "left_anti")
    return refs, others, None if words.where("name is null and n > 0").isEmpty() else every.orderBy(F.asc_nulls_last("name"))


def references(docs: DataFrame, common: int = COMMON, least: int = LEAST_REFERENCE) -> dict[str, dict[str, np.ndarray]]:
    """By language, of the MAX_LANGUAGES largest: class shares; hashes, ascending, and shares of the most common words, the rest last.

    At most MAX_LANGUAGES * (common + classes) numbers reach the driver, counted over all documents."""
    return {x: ref for x, ref in _references(docs, common, least)[0].items() if x is not None}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def widened(limit: float, ref: dict, shares: str) -> float:
    """A limit of the distance to a reference with what the reference may err. Distances count squared here.

    The sampling error of k shares over n words is (k - 1) / (8 n ln 2). One of m documents weighs 1 / m in the reference, and since the
    divergence is convex, it moves a document within the limit by no more than 1 / m of what lies between the limit and 1."""
    error = (len(ref[shares]) - 1) / (8 * np.log(2) * ref["n_words"])
    return max(limit, min(1.0, (limit**2 + max(0.0, 1 - limit**2) / ref["n_docs"] + error) ** 0.5))


def _side_by_side(refs: list[dict]) -> dict:
    """References with all of their keys, ascending, and the references and shares of each key."""
    keys = np.concatenate([r["keys"] for r in refs])
    order = np.argsort(keys, kind="stable")
    distinct, starts = np.unique(keys[order], return_index=True)
    return {
        "refs": refs,
        "classes": np.array([r["classes"] for r in refs]),
        "known": np.array([r["words"][:-1].sum() for r in refs]),
        "rest": np.array([max(r["words"][-1], 0.0) for r in refs]),
        "keys": distinct,
        "starts": np.append(starts, len(keys)),
        "of": np.repeat(np.arange(len(refs)), [len(r["keys"]) for r in refs])[order],
        "shares": np.concatenate([r["words"][:-1] for r in refs])[order],
    }


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References (name, ref) in their order, MAX_LANGUAGES or fewer in a row."""

    def row(refs: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_side_by_side(refs), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["refs"])

    refs = []
    for batch in batches:
        for ref in batch.column(1):
            refs.append(_reference([(r["bucket"], r["key"], r["n"]) for r in ref.as_py()]))
            if len(refs) >= MAX_LANGUAGES:
                yield row(refs)
                refs = []
    if refs:
        yield row(refs)


def _in_turn(refs: dict, every: DataFrame | None) -> Callable[[], Iterable[dict]]:
    """What gives all references in their order, side by side: those held, or of every language, a broadcast for each MAX_LANGUAGES of them, of
    which a task reads one at a time."""
    if every is None:
        whole = [_side_by_side(list(refs.values()))] if refs else []
        return lambda: whole
    sc = every.sparkSession.sparkContext
    parts = [sc.broadcast(bytes(r["refs"])) for r in every.mapInArrow(_packed, "refs binary").toLocalIterator()]

    def read() -> Iterator[dict]:
        for part in parts:
            value = part.value
            if part._path:  # read again the next time, and not kept beside all the others
                part.__dict__.pop("_value", None)
            yield pickle.loads(value)

    return read


def _sums(refs: dict, classes: np.ndarray, doc: np.ndarray, key: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Class and word distance, added, of documents (rows of classes) to references side by side, by the words they share. doc, key, share: the
    distinct words of each document, by document."""

    def terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)

    size = len(refs["refs"])
    at = np.minimum(np.searchsorted(refs["keys"], key), len(refs["keys"]) - 1)
    hit = refs["keys"][at] == key
    doc, share, at = doc[hit], share[hit], at[hit]
    first, times = refs["starts"][at], refs["starts"][at + 1] - refs["starts"][at]
    before = np.append(0, np.cumsum(np.bincount(doc, times, len(classes))))
    out = np.empty((len(classes), size))
    a = 0
    while a < len(classes):
        b = min(len(classes), a + ROWS, max(a + 1, int(np.searchsorted(before, before[a] + ENTRIES, "right")) - 1))
        i, j = np.searchsorted(doc, (a, b))
        n = times[i:j]
        entry = np.arange(int(n.sum())) + np.repeat(first[i:j] - (np.cumsum(n) - n), n)
        cell = np.repeat(doc[i:j] - a, n) * size + refs["of"][entry]
        p, q = np.repeat(share[i:j], n), refs["shares"][entry]
        met = np.bincount(cell, p, (b - a) * size).reshape(b - a, size)
        words = np.bincount(cell, terms(p, q) - q, (b - a) * size).reshape(b - a, size)  # of integers where no word is shared
        words = words + (refs["known"] + terms(np.maximum(1 - met, 0), refs["rest"]))
        kinds = terms(classes[a:b, None, :], refs["classes"][None]).sum(2)
        out[a:b] = np.sqrt(np.clip(kinds / 2, 0, 1)) + np.sqrt(np.clip(words / 2, 0, 1))
        a = b
    return out


def _nearest(parts: Iterable[dict], classes: np.ndarray, hashes: np.ndarray, words: Words, mine: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
    """References in their order, each with those documents whose nearest it may be: every one whose sum of distances is the smallest is there."""
    mine = mine[words.counts[mine] > 0]
    if not len(mine):
        return
    own, doc = hashes[_words_of(mine, words.offs)], np.repeat(np.arange(len(mine)), words.counts[mine])
    order = np.lexsort((own, doc))
    own, doc = own[order], doc[order]
    heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
    share = np.diff(np.append(heads, len(own))) / words.counts[mine][doc[heads]]
    own, doc = own[heads], doc[heads]
    low = np.full(len(mine), np.inf)
    refs: dict[int, dict] = {}
    found: list[tuple] = []

    def settled() -> Iterator[tuple[dict, np.ndarray]]:
        d, r, s = (np.concatenate(x) for x in zip(*found))
        near = s <= low[d] + SLACK
        d, r = d[near], r[near]
        for at in _by_language(r.tolist()):
            yield refs[at[0]], mine[d[at[1]]]

    n, pending = 0, 0
    for part in parts:
        sums = _sums(part, classes[mine], doc, own, share)
        low = np.minimum(low, sums.min(1))
        r, d = np.nonzero((sums <= low[:, None] + SLACK).T)
        found.append((d, r + n, sums[d, r]))
        refs |= {n + i: part["refs"][i] for i in np.unique(r).tolist()}
        n, pending = n + len(part["refs"]), pending + len(r)
        if pending > ENTRIES:
            yield from settled()
            refs, found, pending = {}, [], 0
    if found:
        yield from settled()


def base_counts(data: np.ndarray, offs: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    salt = mix(np.arange(1, len(offs), dtype=np.uint64))
    # Lines: between newlines and document borders; those with a word.
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[held], ends[held]
    line_doc = np.searchsorted(offs, starts, "right") - 1
    line_key = mix(hash_ranges(data, starts, ends, short=0) + salt[line_doc])
    first = np.zeros(len(line_key), bool)
    first[np.unique(line_key, return_index=True)[1]] = True
    n_dup_lines = np.bincount(line_doc[~first], minlength=len(offs) - 1)
    # Words in 8-word windows that a document has twice.
    grams, at = windows(words.hashes(data), words.offs, 8)
    doc = words.docs()
    twice = at[repeated(mix(grams + salt[doc[at]]))]
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, np.minimum(twice + 8, len(words.starts)), 1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": words.counts,
        "word_chars": sum_by_doc(~words.space & ~_TAIL[data], offs),
        "n_symbols": sum_by_doc(_SYMBOL[data], offs),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": sum_by_doc(covered, words.offs),
    }


def _judge(refs: dict, limits: tuple, every: Callable[[], Iterable[dict]]):
    """Verdicts on rows (doc_id, text, lang[, rows of the language's reference]). every: gives all references, side by side."""
    guard_classes, guard_words, most_classes, most_words = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch):
                words = Words(data, offs)
                base = base_counts(data, offs, words)
                n = base["n_words"]
                hashes = words.hashes(LOWER[data])
                classes = _classes(data, offs).astype(float)
                classes /= np.maximum(classes.sum(1, keepdims=True), 1)
                by_class, by_word = np.full(len(n), np.inf), np.full(len(n), np.inf)
                far_class, far_word = np.zeros(len(n), bool), np.zeros(len(n), bool)
                for x, mine in _by_language(part.column(2).to_pylist()):
                    if part.num_columns > 3:
                        ref = part.column(3)[int(mine[0])].as_py()
                        near = [(_reference([(r["bucket"], r["key"], r["n"]) for r in ref]), mine)] if ref else []
                    elif x is None:
                        near = _nearest(every(), classes, hashes, words, mine)
                    else:
                        near = [(refs[x], mine)] if x in refs else []
                    for ref, ids in near:
                        own = hashes[_words_of(ids, words.offs)]
                        doc = np.repeat(np.arange(len(ids)), n[ids])
                        at = np.minimum(np.searchsorted(ref["keys"], own), len(ref["keys"]) - 1)
                        at = np.where(ref["keys"][at] == own, at, len(ref["keys"]))
                        size = len(ref["words"])
                        hist = np.bincount(doc * size + at, minlength=len(ids) * size).reshape(len(ids), size) / np.maximum(n[ids], 1)[:, None]
                        c, w = distance(classes[ids], ref["classes"]), distance(hist, ref["words"])
                        nearer = c + w < by_class[ids] + by_word[ids]
                        to = ids[nearer]
                        by_class[to], by_word[to] = c[nearer], w[nearer]
                        far_class[to] = c[nearer] > widened(most_classes, ref, "classes")
                        far_word[to] = w[nearer] > widened(most_words, ref, "words")
                by_class[np.isinf(by_class) | (n == 0)] = 0.0
                by_word[np.isinf(by_word) | (n == 0)] = 0.0
                failed = (n < 20) | (100 * base["n_repeat_words"] > 30 * n)
                apart = (n >= guard_classes) & far_class | (n >= guard_words) & far_word
                out = [part.column(0), *(pa.array(base[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                out += [pa.array(failed), pa.array(~failed & ~(apart & (n > 0))), pa.array(by_class), pa.array(by_word)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

    return run


def quality(docs: DataFrame, guard_classes: int = GUARD_CLASSES, guard_words: int = GUARD_WORDS, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """A row for each document: doc_id, five counts, base_failed, kept, class_distance, word_distance.

    docs: doc_id, text, lang; other columns are ignored. base_failed: fewer than 20 words, or more than 30% of
    them in 8-word windows that occur twice. kept: not base_failed, and neither distance above its limit, widened by the error of the
    reference, where the document has the words its guard asks for. A null text has no words and fails. A document without a language
    is held against the nearest reference, of all such documents or of a language, however many languages there are; of equally near ones the
    first by name, that of such documents last. Without a reference distances are 0. Repeated rows and null ids come back as they are, texts
    of any length are judged whole. An empty table gives an empty table."""
    refs, others, every = _references(docs, COMMON, least_reference)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    judge = _judge(refs, (guard_classes, guard_words, most_classes, most_words), _in_turn(refs, every))
    if others is None:
        return rows.mapInArrow(judge, schema)
    held = F.col("lang").isNull() | F.col("lang").isin([x for x in refs if x is not None])
    rest = rows.where(~held).join(others, F.col("lang") == F.col("name"), "left").select(*rows.columns, "ref")
    return rows.where(held).mapInArrow(judge, schema).union(rest.mapInArrow(judge, schema))


def kept_rows(docs: DataFrame, guard_classes: int = GUARD_CLASSES, guard_words: int = GUARD_WORDS, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """The rows of docs that quality() keeps, with all columns. Each row is judged where it is read; only rows of languages beyond MAX_LANGUAGES travel, to
    their reference. An empty table gives an empty table."""
    refs, others, every = _references(docs, COMMON, least_reference)
    judge = _judge(refs, (guard_classes, guard_words, most_classes, most_words), _in_turn(refs, every))
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [pa.nulls(batch.num_rows, pa.int64()), batch.column(text).cast(pa.string()), batch.column(lang).cast(pa.string()), *batch.columns[len(names) :]]
            narrow = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang", "ref"][: len(columns)])
            kept = pa.concat_arrays([v.column(7) for v in judge(iter([narrow]))])
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(kept)

    if others is None:
        return docs.mapInArrow(run, docs.schema)
    name, ref = free(docs, "name", "ref")
    own = F.col("lang").cast("string")
    held = own.isNull() | own.isin([x for x in refs if x is not None])
    rest = docs.where(~held).join(others.toDF(name, ref), own == F.col(name), "left").select(*names, ref)
    return docs.where(held).mapInArrow(run, docs.schema).union(rest.mapInArrow(run, docs.schema))


def op4_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
