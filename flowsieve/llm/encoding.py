"""Token ids of texts by public byte-level BPE vocabularies, a slice at a time.

Where all white space of a text is single spaces and newlines between other characters, the usual pre-tokenizer never merges
across it: a space belongs to what follows, a newline stands alone. Such a text is cut there, and a run of ASCII
punctuation after an ASCII letter is cut off too. Each piece is encoded once and remembered by its 64-bit hash; the ids of a slice are then
gathered by NumPy. Pieces not seen before are encoded together, newlines between them. Any other text, and any with a special token in it, is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np

from .kernels import Words, give_back, hash_ranges, mix

#: Pieces of text whose ids a worker remembers, some 30 bytes each. Fewer cost time, not results.
REMEMBERED = 1_500_000
#: The newest of them, in a table of their own, so that a new piece moves few others.
YOUNG = 1 << 16
#: New pieces encoded as one text.
TOGETHER = 500
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: White space beyond ASCII, in UTF-8, by first byte.
_WIDE = {0xC2: ("85", "a0"), 0xE1: ("9a80", "a08e"), 0xE2: (*(f"80{x:02x}" for x in range(0x80, 0x8C)), "80a8", "80a9", "80af", "819f"), 0xE3: ("8080",)}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LEADS = ("", " ", "")
_U = np.uint64


def _json(path: str, special_as_text: bool) -> tuple[Callable[[list[str]], list], list[bytes], bool]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    special = [] if special_as_text else [x.content.encode() for x in t.get_added_tokens_decoder().values()]
    from tokenizers.pre_tokenizers import ByteLevel

    before = t.pre_tokenizer
    usual = t.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space and getattr(before, "use_regex", True)
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], special, usual


def _ranks(path: str) -> tuple[Callable[[list[str]], list], list[bytes], bool]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [t.encode_ordinary(x) for x in texts], [], True


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of runs of `counts` items from `starts`, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Encoder:
    """path: a vocabulary for tokenizers (.json) or of ranks (.tiktoken). special_as_text: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, remembered: int = REMEMBERED, special_as_text: bool = False):
        self.remembered = remembered
        self.whole, self.special, self.usual = _json(path, special_as_text) if path.endswith(".json") else _ranks(path)
        line = self.whole(["\n"])[0]
        self.usual &= len(line) == 1
        self.line = line[0] if line else -1
        self._forget()

    def _forget(self) -> None:
        """Tables (hash, ascending; place and number of ids), the large one first; ids."""
        empty = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.tables = [empty, empty]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, i: int, new: tuple) -> None:
        at = np.searchsorted(self.tables[i][0], new[0])
        self.tables[i] = tuple(np.insert(old, at, x) for old, x in zip(self.tables[i], new))

    def _odd(self, data: np.ndarray, offs: np.ndarray, words: Words) -> np.ndarray:
        """Documents that must be encoded whole."""
        n = len(offs) - 1
        gaps = np.add.reduceat(np.append(words.space, False).astype(np.int64), offs[:-1]) if n else np.zeros(0, np.int64)
        gaps[offs[1:] == offs[:-1]] = 0
        odd = gaps != np.maximum(words.counts - 1, 0)
        bad = [np.flatnonzero(_ODD[data])]
        for first, tails in _WIDE.items():
            at = np.flatnonzero(data == first)
            for tail in map(bytes.fromhex, tails) if len(at) else ():
                hit = at[at + len(tail) < len(data)]
                for j, c in enumerate(tail):
                    hit = hit[data[hit + 1 + j] == c]
                bad.append(hit)
        if self.special:
            text = data.tobytes()
            for s in self.special:
                at = text.find(s)
                while at >= 0:
                    bad.append(np.array([at]))
                    at = text.find(s, at + 1)
        odd[np.searchsorted(offs, np.concatenate(bad), "right") - 1] = True
        return odd if self.usual else np.ones(n, bool)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes new pieces: places and numbers of their ids."""
        parts = ["\n".join(pieces[i : i + TOGETHER]) + "\n" for i in range(0, len(pieces), TOGETHER)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.whole(parts)])
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(keys):
            raise AssertionError("a newline did not stand alone")
        starts = np.append(0, ends[:-1] + 1)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(ids), self.used // 2), np.uint32), ids))
        self.ids[self.used : self.used + len(ids)] = ids
        new = keys, starts + self.used, (ends - starts).astype(np.int32)
        self.used += len(ids)
        self._add(1, new)
        if len(self.tables[1][0]) > YOUNG:
            self._add(0, self.tables[1])
            self.tables[1] = tuple(x[:0] for x in self.tables[1])
        return new[1:]

    def _remembered(self, keys: np.ndarray, first: np.ndarray, last: np.ndarray, lead: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the pieces' ids."""
        kinds, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) + len(kinds) > self.remembered:
            self._forget()
        start, n = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int32)
        for known, places, counts in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
                here = known[at] == kinds
                start[here], n[here] = places[at[here]], counts[at[here]]
        new = np.flatnonzero(start < 0)
        if len(new):
            i = example[new]
            start[new], n[new] = self._learn(kinds[new], [_LEADS[x] + data[a:b].tobytes().decode() for x, a, b in zip(lead[i].tolist(), first[i].tolist(), last[i].tolist())])
        return start[inverse], n[inverse].astype(np.int64)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that can be cut: document, place and number of each piece's ids, and whether a newline comes before it; and the documents that can't be cut."""
        words = Words(data, offs)
        odd = self._odd(data, offs, words)
        doc = words.docs()
        mine = ~odd[doc]
        first, last, doc = words.starts[mine], words.ends[mine], doc[mine]
        lead = np.where(first == offs[doc], 0, np.where(data[np.maximum(first - 1, 0)] == 10, 2, 1))
        # A run of punctuation at the end, after an ASCII letter.
        end = last.copy()
        open_ = np.flatnonzero(_MARK[data[end - 1]]) if len(end) else np.zeros(0, np.int64)
        while len(open_):
            end[open_] -= 1
            open_ = open_[end[open_] > first[open_]]
            open_ = open_[_MARK[data[end[open_] - 1]]]
        end = np.where((end > first) & _LETTER[data[np.maximum(end - 1, 0)]], end, last)
        split = end < last
        word = np.repeat(np.arange(len(first)), 1 + split)
        tail = np.cumsum(1 + split)[split] - 1
        a, b, d, lead = first[word], end[word], doc[word], lead[word]
        a[tail], b[tail], lead[tail] = end[split], last[split], 0
        keys = mix(hash_ranges(data, a, b) + (lead == 1).astype(_U) * _U(0x9E3779B97F4A7C15))
        return d, *self._remembered(keys, a, b, lead, data), lead == 2, np.flatnonzero(odd)

    def _whole(self, data: np.ndarray, offs: np.ndarray, which: np.ndarray) -> list:
        return [self.whole([data[offs[i] : offs[i + 1]].tobytes().decode()])[0] for i in which.tolist()]

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Ids in each of a slice of texts."""
        d, _, counts, broken, which = self._pieces(data, offs)
        sizes = np.bincount(d, counts + broken, len(offs) - 1).astype(np.int64)
        sizes[which] = [len(t) for t in self._whole(data, offs, which)]
        return sizes

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, one after the other, and where each text's begin and end."""
        d, places, own, broken, which = self._pieces(data, offs)
        n = len(offs) - 1
        counts = own + broken  # a newline's own id comes before what follows it
        flat = np.full(int(counts.sum()), self.line, np.int64).astype(np.uint32)
        begin = np.cumsum(counts) - counts
        flat[ragged(begin + broken, own)] = self.ids[ragged(places, own)]
        sizes = np.bincount(d, counts, n).astype(np.int64)
        if len(which):
            text = self._whole(data, offs, which)
            here = np.cumsum(sizes)[which]
            flat = np.insert(flat, np.repeat(here, [len(t) for t in text]), np.concatenate([np.array(t, np.uint32) for t in text]))
            sizes[which] = [len(t) for t in text]
        return flat, np.append(0, np.cumsum(sizes))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED, special_as_text: bool = False) -> Encoder:
    """One of each kind in a worker."""
    key = path, remembered, special_as_text
    return _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))


def forget() -> None:
    """Gives up all encoders of this worker, for tasks after which it has other things to do."""
    _encoders.clear()
    give_back()
