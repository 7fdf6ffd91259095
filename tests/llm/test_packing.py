import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from flowsieve.llm import encoding
from flowsieve.llm.encoding import Encoder
from flowsieve.llm.kernels import slices
from flowsieve.llm.packing import best_fit, pack, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, window=2048):
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for i, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and zlib.crc32(ids[i][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(map(len, ids.values())), len(seqs)


def test_pieces_and_sequences(docs, docs_rows, tokenizer):
    total, n = check(pack(docs, PATH).collect(), docs_rows, tokenizer)
    assert n <= -(-total // 2048) + 1
    small, m = check(pack(docs, PATH, window=64, group=50).collect(), docs_rows, tokenizer, 64)
    assert m * 64 <= 1.1 * small + 64 * 8


def test_ids_come_back(docs, docs_rows, tokenizer):
    packed = sequences(pack(docs, PATH, window=128, keep_ids=True), 128).collect()
    assert all(len(r.ids) == 128 and r.used <= 128 for r in packed)
    assert sum(r.used for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs_rows)


def test_nulls_repeats_and_nothing(odd_ids, empty):
    rows = pack(odd_ids, PATH).collect()
    assert sum(r.start == 0 for r in rows) == 28 and any(r.doc_id is None for r in rows)
    assert pack(empty, PATH).count() == 0


ODD = ["a\n\nb", "a  b", " a", "a ", "\n", "a\tb c", "it's. he'll, x", "x1. y2,", "é. ñ, ǘ. z", "a\nb. c", "a b c", "... a", "a\n... b", "日本. 語", "a\x1cb c", "a\rb c", "\ra b", "a.b. c", "<|endoftext|>", "a <|endoftext|> b", "x\u00a0 y", "x \u3000y", "x\u2028 y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_encoder_equals_whole_texts(name, docs_rows, monkeypatch):
    monkeypatch.setattr(encoding, "YOUNG", 40)
    rng = random.Random(4)
    alphabet = ["a", "b", "B", "é", "日", "'s", "'", "1", "23", ".", "!!", "#", " ", "\n", " ", "  ", "\t", "\u00a0", "\u3000", "\x1c", "\r", "<|endoftext|>", "-", "e\u0301", "😀", "\x00", "\u180e", "'ll"]
    texts = ODD + [t or "" for _, t in docs_rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    made = Encoder(public_tokenizers.path(name), remembered=500)
    for limit in (1 << 12, 1 << 20, 1 << 12):
        for part, data, offs in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), limit=limit):
            flat, bounds = made.encode(data, offs)
            plain = made.whole(part.column(0).to_pylist())
            assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [list(x) for x in plain]


def test_special_tokens_as_text_or_not():
    text = b"a <|endoftext|> b"
    ids = [Encoder(PATH, special_as_text=x).encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist() for x in (False, True)]
    assert 50256 in ids[0] and 50256 not in ids[1]


def test_best_fit_takes_the_tightest():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    at, offsets = best_fit(lengths, 100)
    free = []
    for n, w, o in zip(lengths, at, offsets):
        fits = [c for c in free if c >= n]
        if fits:
            assert free[w] == min(fits) and o == 100 - free[w]
            free[w] -= n
        else:
            assert w == len(free) and o == 0
            free.append(100 - n)
