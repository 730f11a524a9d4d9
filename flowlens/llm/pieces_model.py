"""SentencePiece models in numpy: equal-length words advance together over tables of which substrings are pieces."""

from __future__ import annotations

import heapq
import re

import numpy as np

SPACE = "▁"
#: Words whose ids are remembered; a full memory is emptied.
CACHE_WORDS = 300_000
#: Longer words are merged with a queue each.
LONG = 192
_MULT = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6


class PieceModel:
    """Encodes and decodes with the pieces of a SentencePiece file of type unigram or BPE.

    Unigram: Viterbi, the segmentation of the greatest sum of scores. BPE: neighbours whose joined piece has
    the greatest score merge first, leftmost of equals. Characters that no piece has become their UTF-8
    bytes' pieces, or the unknown id where a model has none.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        self.kind = model.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        if any(p.type in (_USER, _UNUSED) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined pieces, unused pieces and white space as suffix are not supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are but for the escaped blanks")
        if not spec.add_dummy_prefix:
            raise ValueError("only models that put a blank in front of texts")
        normal = [(p.piece, k) for k, p in enumerate(model.pieces) if p.type == _NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("a piece spans a word's end")
        self.longest = max(len(p) for p, _ in normal)
        keys = np.array([self._hash(p) for p, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([k for _, k in normal], np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.score = np.array([p.score for p in model.pieces] + [-np.inf])  # the last for "no piece", which is -1
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.unknown_score = float(self.score[self.ids].min()) - 10
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else b" \xe2\x81\x87 " if p.type == _UNKNOWN else b"" for p in model.pieces]
        self.memory: dict[str, bytes] = {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_MULT)) & 0xFFFFFFFFFFFFFFFF
        return h

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The piece ids of hashes, -1 where none: a bitmap first, then the sorted keys."""
        out = np.full(h.shape, -1, np.int32)
        spots = np.nonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        found = h[spots]
        k = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        out[spots] = np.where(self.keys[k] == found, self.ids[k], -1)
        return out

    def _table(self, chars: np.ndarray) -> np.ndarray:
        """(word, start, length) -> piece id; -1 where the substring is no piece."""
        b, n = chars.shape
        widest = min(self.longest, n)
        table = np.full((b, n, self.longest + 1), -1, np.int32)
        c = chars.astype(np.uint64) + np.uint64(1)
        h = np.zeros((b, n), np.uint64)
        for size in range(1, widest + 1):
            h = (h[:, : n - size + 1] + c[:, size - 1 :]) * _MULT
            table[:, : n - size + 1, size] = self._probe(h)
        return table

    def _viterbi(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the best segmentations, in order."""
        b, n, _ = table.shape
        best, back = np.full((b, n + 1), -np.inf), np.zeros((b, n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for size in range(1, min(self.longest, end) + 1):
                s = self.score[table[:, end - size, size]]
                if size == 1:
                    s = np.where(np.isneginf(s), self.unknown_score, s)
                s = s + best[:, end - size]
                better = (s >= best[:, end]) & ~np.isneginf(s)  # of equal sums the longer last piece
                best[better, end], back[better, end] = s[better], end - size
        words, at, out = np.arange(b), np.full(b, n), []
        while len(words):
            start = back[words, at]
            out.append((words, start, at))
            words, at = words[start > 0], start[start > 0]
        w, s, e = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((s, w))
        return w[order], s[order], e[order]

    def _merge(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the symbols that merging leaves, in order: every unfinished word merges one pair a round."""
        b, n, _ = table.shape
        words, cuts, out = np.arange(b), np.tile(np.arange(n + 1), (b, 1)), []
        while len(words):
            if cuts.shape[1] > 2:
                start, size = cuts[:, :-2], cuts[:, 2:] - cuts[:, :-2]
                ids = np.where(size <= self.longest, table[words[:, None], start, np.minimum(size, self.longest)], -1)
                s = self.score[ids]
                k = s.argmax(1)
                done = np.isneginf(s[np.arange(len(k)), k])
            else:
                done = np.ones(len(words), bool)
            if done.any():
                c = cuts[done]
                out.append((np.repeat(words[done], c.shape[1] - 1), c[:, :-1].ravel(), c[:, 1:].ravel()))
                if done.all():
                    break
                words, cuts, k = words[~done], cuts[~done], k[~done]
            keep = np.ones(cuts.shape, bool)
            keep[np.arange(len(k)), k + 1] = False
            cuts = cuts[keep].reshape(len(words), -1)
        w, s, e = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((s, w))
        return w[order], s[order], e[order]

    def _merge_long(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long word, with a queue of pairs."""
        n = table.shape[1]
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = ends[a]
            if b < n and ends[b] - a <= self.longest and (k := table[0, a, ends[b] - a]) >= 0:
                heapq.heappush(queue, (-self.score[k], a, ends[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, end = heapq.heappop(queue)
            if not alive[a] or ends[a] >= n or ends[ends[a]] != end or not alive[ends[a]]:
                continue
            alive[ends[a]] = False
            ends[a] = end
            if end < n:
                before[end] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts = np.array([a for a in range(n) if alive[a]])
        return np.zeros(len(starts), int), starts, np.array([ends[a] for a in starts])

    def _batch(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
        table = self._table(chars)
        w, s, e = self._viterbi(table) if self.kind == _UNIGRAM else self._merge(table) if n <= LONG else self._merge_long(table)
        ids = table[w, s, e - s]
        missing = np.flatnonzero(ids < 0)
        if len(missing):  # only single characters can be
            spelled = [self._spell(chr(c)) for c in chars[w[missing], s[missing]]]
            sizes = np.ones(len(ids), int)
            sizes[missing] = [len(x) for x in spelled]
            at = np.cumsum(sizes) - sizes
            full = np.empty(int(sizes.sum()), np.int32)
            full[at] = ids
            for k, x in zip(at[missing], spelled):
                full[k : k + len(x)] = x
            ids, w = full, np.repeat(w, sizes)
        cuts = np.searchsorted(w, np.arange(1, len(words)))
        data = ids.astype("<u4").tobytes()
        edges = [0, *(cuts * 4).tolist(), len(data)]
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _spell(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode()] if self.byte else [self.unknown]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words, each without its first blank."""
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > CACHE_WORDS:
            self.memory.clear()
            new = list(words)
        new.sort(key=len)
        at = 0
        while at < len(new):
            n = len(new[at]) + 1
            most = 1 if n > LONG else max(1, (8 << 20) // (n * (self.longest + 1) * 4))
            end = at
            while end < len(new) and end - at < most and len(new[end]) + 1 == n:
                end += 1
            part = new[at:end]
            self.memory.update(zip(part, self._batch([SPACE + w for w in part])))
            at = end

    def units(self, text: str) -> list[str]:
        """The words of a text, each without its first blank; further leading blanks stay."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.units(t) for t in texts]
        self._learn(set().union(*cut))
        got = self.memory.__getitem__
        return [b"".join(map(got, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces are silent, and bytes that are no UTF-8 become U+FFFD."""
        parts = (b"".join(map(self.surface.__getitem__, ids[a : a + (1 << 18)].tolist())) for a in range(0, len(ids), 1 << 18))
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text
