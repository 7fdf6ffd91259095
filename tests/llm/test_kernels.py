import random

import numpy as np
import pyarrow as pa

from flowsieve.llm import kernels as k

from . import brute


def batch(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


def test_words_in_slices():
    rng = random.Random(1)
    texts = ["", None, "a b  c", " x", "Hello\nwörld x ", "\n\n"] + ["".join(rng.choice("ab \n\té\x0b") for _ in range(rng.randrange(30))) for _ in range(300)]
    for limit in (40, 1 << 20):
        got = []
        for _, data, offs in k.slices(batch(texts), limit=limit):
            w = k.Words(data, offs)
            for a, b in zip(w.offs[:-1], w.offs[1:]):
                got.append([bytes(data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])])
        assert got == [brute.words(t) for t in texts]


def test_shingles_count_distinct():
    texts = ["a b c d e a b c d e", "A b", "", "x " * 50, "one two three four"]
    _, data, offs = next(k.slices(batch(texts)))
    assert [len(s) for s in k.shingle_sets(data, offs, 4)] == [len(brute.shingles(t, 4)) for t in texts]
    a, b = (k.shingle_sets(*next(k.slices(batch([t])))[1:], 3)[0] for t in ("Ab c d", "ab C d"))
    assert (a == b).all()


def test_packing_of_integers():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (k.unpack_sorted(k.pack_sorted(keys)) == keys).all()
    assert len(k.unpack_sorted(k.pack_sorted(keys[:0]))) == 0
    ids = np.array([-5, 1 << 40, 3], np.int64)
    assert (k.unpack_ints(k.pack_ints(ids), np.int64) == ids).all()
    key, count = k.merge_counts([keys[:3], keys[1:4]], [np.ones(3, np.int64), np.ones(3, np.int64)])
    assert (key == keys[:4]).all() and count.tolist() == [1, 2, 2, 1]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_self_similar_words_and_lines_differ():
    x, y = thue_morse(2048), thue_morse(2048, True)
    _, data, offs = next(k.slices(batch([x, y, x])))
    a, b, c = k.Words(data, offs).hashes(data)
    assert a != b and a == c
    one, two, three = k.shingle_sets(data, offs, 4)
    assert one != two and one == three
    assert brute.quality_counts("\n".join([x, y, x]))[3] == 1
    from flowsieve.llm.quality import base_counts

    _, data, offs = next(k.slices(batch(["\n".join([x, y, x]), "\n".join([x, y])])))
    assert base_counts(data, offs, k.Words(data, offs))["n_dup_lines"].tolist() == [1, 0]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice((3, 8, 40)))) for _ in range(800))
    _, data, offs = next(k.slices(batch([text])))
    words = k.Words(data, offs)
    whole = words.hashes(data)
    monkeypatch.setattr(k, "BLOCK", 64)
    assert (words.hashes(data) == whole).all()
    assert len(set(whole.tolist())) == len(set(brute.words(text)))
