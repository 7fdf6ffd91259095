"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, size):
    w = words(text, True)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs, size, percent):
    sets = {i: shingles(t, size) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(links, sets)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def repeated(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        flags = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                flags[p : p + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(x for x, f in zip(b, flags) if not f)
        out[i] = (len(b), sum(flags), len(re.findall(b"\x01+", bytes(flags))), hashlib.sha256(kept).hexdigest())
    return out


def base_scores(docs):
    tokens = {i: words(t, True) + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}


def quality_counts(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


CLASS_OF = {**{c: 0 for c in range(97, 123)}, **{c: 1 for c in range(65, 91)}, **{c: 2 for c in range(48, 58)}, **{c: 3 for c in (9, 10, 11, 12, 13, 32)}, **{ord(c): 4 for c in ".,;:?'\"()-"}}


def char_class(c):
    o = ord(c)
    if o in CLASS_OF:
        return CLASS_OF[o]
    if o < 128:
        return 6 if o < 32 or o == 127 else 5
    return 7 if o < 0x800 else 8 if o < 0x10000 else 9


def jensen_shannon(p, q):
    d = 0.0
    for x, y in zip(p, q):
        m = (x + y) / 2
        d += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(min(max(d / 2, 0), 1))


def quality_verdicts(rows, guards=(40, 80), limits=(0.25, 0.55)):
    """kept of each (id, text, lang), with every word of a language in its reference."""
    refs = {}
    for _, t, lang in rows:
        ref = refs.setdefault(lang, {"chars": Counter(), "words": Counter(), "squares": 0})
        w = words(t, True)
        ref["chars"].update(map(char_class, t or ""))
        ref["words"].update(w)
        ref["squares"] += len(w) ** 2
    refs = {k: r for k, r in refs.items() if r["words"]}

    def distances(t, ref):
        chars, own = Counter(map(char_class, t or "")), Counter(words(t, True))
        n, m = sum(own.values()), sum(ref["words"].values())
        by_class = jensen_shannon([chars[c] / max(sum(chars.values()), 1) for c in range(10)], [ref["chars"][c] / sum(ref["chars"].values()) for c in range(10)])
        known = list(ref["words"])
        by_word = jensen_shannon([own[w] / n for w in known] + [sum(own[w] for w in own if w not in ref["words"]) / n], [ref["words"][w] / m for w in known] + [0.0])
        docs = m**2 / ref["squares"]
        wide = [max(x, min(1.0, math.sqrt(x**2 + max(0.0, 1 - x**2) / docs + (k - 1) / (8 * math.log(2) * m)))) for x, k in zip(limits, (10, len(known) + 1))]
        return by_class, by_word, by_class > wide[0], by_word > wide[1]

    out = {}
    for i, t, lang in rows:
        n, _, _, _, rep = quality_counts(t)
        kept = not (n < 20 or 100 * rep > 30 * n)
        near = list(refs.values()) if lang is None else [refs[lang]] if lang in refs else []
        if kept and near:
            _, _, far_class, far_word = min((distances(t, r) for r in near), key=lambda d: d[0] + d[1])
            kept = not (n >= guards[0] and far_class or n >= guards[1] and far_word)
        out[i] = kept
    return out


def scores(docs, rounds=2000):
    """Deleted interpolation with exact ratios: weights by context level, learned on held-out tokens."""
    tokens = {i: words(t, True) + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    one, two = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip([""] + t[:-1], t))
    total, kinds = sum(one.values()), len(one)
    starts = sum(1 for i in tokens if not held[i])

    def parts(t):
        for before, w in zip([""] + t[:-1], t):
            c = starts if before == "" else one[before]
            level = int(math.floor(math.log2(c))) + 1 if c else 0
            yield level, (two[before, w] / c if c else 0.0, one[w] / total if total else 0.0, 1 / (kinds + 1))

    def fit(rows):
        a = [1 / 3] * 3
        for _ in range(rounds):
            new = [0.0] * 3
            for p in rows:
                s = sum(x * y for x, y in zip(a, p))
                for j in range(3):
                    new[j] += a[j] * p[j] / s
            new = [max(x / len(rows), f) for x, f in zip(new, (0, 0, 1e-6))]
            new = [x / sum(new) for x in new]
            if max(abs(x - y) for x, y in zip(a, new)) < 1e-9:
                break
            a = new
        return a

    seen = {}
    for i, t in tokens.items():
        if held[i]:
            for level, p in parts(t):
                seen.setdefault(level, []).append(p)
    pooled = fit([p for rows in seen.values() for p in rows]) if seen else [1 / 3] * 3
    weights = {level: fit(rows) for level, rows in seen.items() if len(rows) >= 200}
    return {i: sum(math.log10(sum(x * y for x, y in zip(weights.get(level, pooled), p))) for level, p in parts(t)) for i, t in tokens.items()}


def kept_texts(docs, length=100):
    """Texts without the bytes that repeated() removes; a character that loses some goes whole."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(s)
        out[i] = bytes(x for x, f in zip(b, gone) if not f).decode("utf-8", "ignore")
    return out


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / w > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else weight[s] * rest / w for s in names}
        full |= over


def mix_times(rows):
    """How often each (id, text, source) is taken; ids are unique."""
    size = {i: len(words(t)) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    goal, out = targets({s: sizes[s] for _, _, s in rows}), {}
    for s in {s for _, _, s in rows}:
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, before = goal[s] - whole * sizes[s], 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            more = before + size[i] <= rest or before <= rest and (rest - before) * 2 >= size[i]
            out[i] = min(3, whole + more) if size[i] or whole else (min(3, whole + more))
            before += size[i]
    return out
