"""Encoding texts with a byte-level BPE tokenizer by way of their units, in numpy.

Texts are cut where a pre-token always ends: before a blank between visible characters, around a
newline between such, and between an ASCII letter and a stop behind it. A unit's ids then don't depend on what is
around it, so the tokenizer sees a unit once while it is remembered. Where in doubt nothing is cut, and of
tokenizers that prepare or split texts in any other way than the plain byte-level one, whole texts are encoded.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Units of up to this many bytes are remembered, by their bytes themselves.
SHORT = 24
#: How many are remembered; a full memory is emptied.
MEMORY = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
#: Bytes that may stand beside a cut: no ASCII white space or control characters.
_VISIBLE = np.ones(256, bool)
_VISIBLE[:33] = False
#: First bytes of the two- and three-byte forms of all other white space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


_AS_LETTERS = _byte_letters()


def unit_starts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in b, in which texts lie at starts one behind another (empty ones left out)."""
    first = np.zeros(len(b) + 1, bool)
    first[starts] = True
    before = np.roll(b, 1)
    alone = np.zeros(len(b), bool)
    at = np.flatnonzero((b == 32) | (b == 10))
    at = at[(at >= 3) & (at < len(b) - 1)]
    p, q = b[at - 1], b[at + 1]
    # other white space: C2 A0, C2 85, E1 9A 80, E2 80 .., E2 81 9F, E3 80 80
    odd = (b[at - 2] == 0xC2) | (_LEAD[b[at - 3]] & (p >= 0x80) & (b[at - 2] >= 0x80)) | _LEAD[q]
    alone[at[_VISIBLE[p] & _VISIBLE[q] & ~odd & ~first[at] & ~first[at - 1] & ~first[at - 2] & ~first[at + 1]]] = True
    cut = alone.copy()
    cut[1:] |= (alone & (b == 10))[:-1]
    cut |= _LETTER[before] & _STOP[b]
    cut |= first[:-1]
    return np.flatnonzero(cut)


def cuts_hold(spec: dict) -> bool:
    """Whether a tokenizer file is such that units' ids add up to those of their text."""
    split = spec.get("pre_tokenizer") or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    model = spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None

    def uncut(token: dict) -> bool:
        text = token["content"].encode()
        return not (token["lstrip"] or token["rstrip"] or token["single_word"]) and b" " not in text and b"\n" not in text and len(unit_starts(np.frombuffer(b"..." + text + b"...", np.uint8), np.zeros(1, np.int64))) == 1

    return byte_level and plain and whole and all(map(uncut, spec.get("added_tokens") or []))


class UnitEncoder:
    def __init__(self, vocab: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        with open(vocab, encoding="utf-8") as f:
            self.cuts = cuts_hold(json.load(f))
        self.tokenizer.model._resize_cache(0)  # units come once
        self.bare = Tokenizer(self.tokenizer.model)
        #: How many bytes each id stands for.
        self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.count, self.filled = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.empty((1 << 15, 4), np.uint64)  # a row is half a cache line
        self.offset, self.size = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int32)
        self.flat = np.empty(1 << 17, np.uint32)

    # ---- the memory: open addressing over (three words of bytes, length) ----

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _M[0] ^ keys[:, 1] * _M[1] ^ keys[:, 2] * _M[2] ^ keys[:, 3] * _M[3]
        h ^= h >> np.uint64(32)
        h *= _M[0]
        return (h >> np.uint64(20)).astype(np.int64)

    def _find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        mask = len(self.slots) - 1
        live, at = np.arange(len(h)), h & mask
        while len(live):
            entry = self.slots[at]
            used = entry >= 0
            live, at, entry = live[used], at[used], entry[used]
            same = (self.keys[entry] == keys[live]).all(1)
            out[live[same]] = entry[same]
            live, at = live[~same], (at[~same] + 1) & mask
        return out

    def _place(self, entries: np.ndarray, h: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several for one slot the last stays
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & mask

    def _remember(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Enter distinct new keys with their ids, laid one behind another; their entries."""
        n = len(keys)
        while self.count + n > len(self.offset):
            self.keys = np.concatenate([self.keys, np.empty_like(self.keys)])
            self.offset, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.offset, self.size))
        self._room(len(ids))
        entries = np.arange(self.count, self.count + n, dtype=np.int32)
        self.keys[entries], self.size[entries] = keys, sizes
        self.offset[entries] = self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.count, self.filled = self.count + n, self.filled + len(ids)
        if 2 * self.count > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            every = np.arange(self.count, dtype=np.int32)
            self._place(every, self._hash(self.keys[: self.count]))
        else:
            self._place(entries, self._hash(keys))
        return entries

    def _room(self, n: int) -> None:
        while self.filled + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])

    # ---- the tokenizer ----

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind another, how many each) of units. Letters behind a blank or not are one pre-token, so the bare model takes many as one sequence."""
        plain = [self.cuts and (u.isalpha() or (u[0] == " " and u[1:].isalpha())) for u in units]
        parts: list[np.ndarray] = []
        sizes = np.empty(len(units), np.int64)
        of = np.flatnonzero(plain)
        for at in range(0, len(of), 20_000):
            part = of[at : at + 20_000]
            mapped = "\n".join([units[k] for k in part.tolist()]).encode().decode("latin-1").translate(_AS_LETTERS).split(_AS_LETTERS[10])
            ids = np.array(self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(m) for m in mapped])) + 1  # ids and units cover the same bytes
            sizes[part] = np.diff(ends, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~np.array(plain, bool))
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000].tolist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast([units[k] for k in part], add_special_tokens=False)]
            sizes[part] = [len(x) for x in found]
            parts.append(np.array([i for x in found for i in x], np.uint32))
        joined = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        order = np.concatenate([of, rest])
        if len(order) and (np.diff(order) < 0).any():  # back into the units' own order
            begin = np.empty(len(units), np.int64)
            begin[order] = np.cumsum(sizes[order]) - sizes[order]
            joined = joined[_spread(begin, sizes)]
        return joined, sizes

    def encode(self, data: bytes, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind another, how many each) of texts, whose UTF-8 bytes lie in data one behind another; each closed by end."""
        if not len(data):
            return np.full(len(lengths), end, np.uint32), np.ones(len(lengths), np.int64)
        b = np.frombuffer(data + bytes(SHORT), np.uint8)
        text_starts = np.cumsum(lengths) - lengths
        starts = text_starts[lengths > 0]
        if self.cuts:
            starts = unit_starts(b[: len(data)], starts)
        sizes = np.diff(starts, append=len(data))
        words = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))  # eight bytes from every place on
        short = np.flatnonzero(sizes <= SHORT)
        s, n = starts[short], sizes[short]
        keys = np.empty((len(short), 4), np.uint64)
        for k in range(3):
            keys[:, k] = words[s + 8 * k] & _MASK[np.clip(n - 8 * k, 0, 8)]
        keys[:, 3] = n
        if self.count + len(short) // 4 > MEMORY:
            self._forget()
        h = self._hash(keys)
        entry = self._find(keys, h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            order = np.argsort(h[new])  # equal keys lie together; were others of their hash between, a key would be entered twice
            k = keys[new[order]]
            head = np.ones(len(order), bool)
            head[1:] = (k[1:] != k[:-1]).any(1)
            one = new[order[head]]
            units = [data[x : x + y].decode() for x, y in zip(s[one].tolist(), n[one].tolist())]
            ids, counts = self._ids(units)
            entry[new[order]] = self._remember(keys[one], ids, counts)[np.cumsum(head) - 1]
        count, begin = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        count[short], begin[short] = self.size[entry], self.offset[entry]
        long = np.flatnonzero(sizes > SHORT)
        if len(long):  # their ids lie behind the remembered ones until the next units come
            ids, counts = self._ids([data[x : x + y].decode() for x, y in zip(starts[long].tolist(), sizes[long].tolist())])
            count[long], begin[long] = counts, self.filled + np.cumsum(counts) - counts
            self._room(len(ids))
            self.flat[self.filled : self.filled + len(ids)] = ids
        text = np.searchsorted(text_starts, starts, "right") - 1
        per_text = np.bincount(text, count, len(lengths)).astype(np.int64)
        body = self.flat[_spread(begin, count)]
        totals = per_text + 1
        out = np.full(int(totals.sum()), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(totals) - 1] = False
        out[keep] = body
        return out, totals


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run of count places."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, UnitEncoder] = {}


def encoder_for(vocab: str) -> UnitEncoder:
    """This process's encoder: a worker keeps what it has learnt from one task to the next."""
    if vocab not in _encoders:
        _encoders[vocab] = UnitEncoder(vocab)
    return _encoders[vocab]
