"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import pieces, texts
from .common import ship
from .crf import Field, train

KINDS = ("email", "ip", "card", "phone")
#: O, then B- and I- of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

Span = tuple[str, int, int]

# ---- the fixed patterns ----

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits fails or matches as a whole, so no try starts within one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _phone(text: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in the order of KINDS; failing ones dropped without another try.

    Emails are found from their @ signs outwards, so long runs of address characters cost no more than their length.
    """
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            end = d.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern, valid in (("ip", _IP, _ip), ("card", _CARD, _card), ("phone", _PHONE, _phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return out


# ---- the random field ----

#: Words that hint at personal data, among the features of a token and its neighbours.
HINTS = frozenset("at dot tel phone mobile call fax mail email ip host server card visa credit version page date isbn order".split())
#: The label that plain words may carry, inside a spelled-out address.
INNER = LABELS.index("I-email")
#: Words whose scores are added up at once.
WORDS_AT_ONCE = 65_536
#: Links of the chains that advance together; a longer chain comes alone.
LINKS_AT_ONCE = 1 << 18
#: Characters of a text that are split into words at once, a word at least.
SPLIT = 1 << 20
#: Words and kinds of words a decoder remembers; a full memory is emptied.
MEMORY = 200_000
_TOKEN = re.compile(r"\S+")
_BLANK = re.compile(r"\s")
_TO_SHAPE = str.maketrans({**{c: "d" for c in "0123456789"}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})
_RUN = re.compile(r"(x)x+|(X)X+|[^\W\d_xXd]+")
_DIGITS = re.compile("d+")
_TAIL = ".,;:!?\"'»)]"


def token_key(token: str) -> tuple[str, ...]:
    """The features of a token itself: its shape with and without the lengths of digit runs, how many digits, hints."""
    word = token.rstrip(_TAIL) or token
    shape = _RUN.sub(lambda m: m[1] or m[2] or "x", word.translate(_TO_SHAPE))
    n = shape.count("d")
    hint = word.lower().strip("()[].:,")
    digits = _DIGITS.sub(lambda m: f"d{len(m[0])}", shape)
    return (
        "s=" + digits, "c=" + _DIGITS.sub("d", shape), f"n={min(n, 20)}", "h=" + (hint if hint in HINTS else "-"), "f=" + word[:1].translate(_TO_SHAPE),
        "p=" + "".join(sorted({c for c in word if not c.isalnum()})), "t=" + token[-1:].translate(_TO_SHAPE),
    )


def _features(keys: list[tuple[str, ...]], j: int) -> list[str]:
    out = [f"0{f}" for f in keys[j]]
    for step in (-2, -1, 1, 2):
        out += [f"{step}{f}" for f in keys[j + step]] if 0 <= j + step < len(keys) else [f"{step}end"]
    return out


def labelled_table(n: int = 500, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: n invented lines as (tokens, labels), with personal data in usual and unusual forms and look-alikes."""
    r = random.Random(seed)
    syllables = "an er th on re ti lo mi sa be ko le qué für èv ou".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    some = lambda k: "".join(r.choices("0123456789", k=k))
    name = lambda: r.choice([word(), f"{word()}.{some(2)}", f"{word()}_{word()}"])
    top = lambda: r.choice(["com", "org", "net", "de", "fr"])

    def card() -> str:
        d = r.choice("3456") + some(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def quads(sep: str) -> str:
        c = card()
        return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    def sign(word: str) -> str:
        word = r.choice([word, word, word.title(), word.upper()])
        return r.choice(["({})", "[{}]"]).format(word)

    groups = lambda *sizes: [some(k) for k in sizes]
    octets = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    made = {
        "email": [
            lambda: f"{name()}@{word()}.{top()}", lambda: f"{name()} {sign('at')} {word()}.{top()}", lambda: f"{name()} {sign('at')} {word()} {sign('dot')} {top()}", lambda: f"{name()}{sign('at')}{word()}.{top()}",
            lambda: f"{name()} at {word()} dot {top()}", lambda: f"{name()} AT {word()} DOT {top()}",
        ],
        "ip": [
            octets, octets, lambda: ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8)), lambda: f"{r.randint(8192, 16383):x}:{r.randint(256, 4095):x}::{r.randint(1, 4095):x}",
            lambda: "".join(r.choices("abcdef", k=4)) + ":" + "".join(r.choices("abcdef", k=r.randint(2, 4))) + "::", lambda: f"fe80::{r.randint(1, 65535):x}",
        ],
        "card": [card, lambda: quads(" "), lambda: quads("-"), lambda: quads("."), lambda: quads("/")],
        "phone": [lambda: "+1 ({}) {}-{}".format(*groups(3, 3, 4)), lambda: "({}) {}-{}".format(*groups(3, 3, 4)), lambda: "-".join(groups(3, 3, 4)), lambda: ".".join(groups(3, 3, 4)), lambda: "+{} {} {}".format(*groups(2, 3, 7)), lambda: "1-" + "-".join(groups(3, 3, 4)), lambda: "0{}/{}".format(*groups(3, 7)), lambda: " ".join(groups(3, 3, 4)), lambda: "0{} {}".format(*groups(2, 7)), lambda: "0{} {} {}".format(*groups(2, 4, 4))],
    }
    alike = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"${r.randint(1, 99)},{some(3)}.{some(2)}",
        lambda: f"version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: some(r.randint(1, 12)), lambda: f"{r.randint(10, 23)}:{some(2)}:{some(2)}",
        lambda: f"#{some(6)}", lambda: f"isbn 978-{some(1)}-{some(2)}-{some(6)}-{some(1)}", lambda: f'token = "{r.getrandbits(160):040x}"', lambda: f"{r.getrandbits(64):016x}", lambda: f"@{word()}", lambda: f"page {r.randint(1, 400)} at {r.randint(1, 9)}",
        lambda: f"order {some(4)}-{some(7)}-{some(7)}", lambda: f"{some(2)}%", lambda: f"https://{word()}.{top()}/{some(5)}", lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"{some(3)},{some(3)},{some(3)}", lambda: f"{some(1)}.{some(2)}",
        lambda: " ".join(some(r.randint(1, 4)) for _ in range(r.randint(2, 6))), lambda: f"{r.randint(1900, 2030)} {r.randint(1900, 2030)}", lambda: f"look at {word()}", lambda: f"the dot {word()}", lambda: f"{word()} at {word()} {word()}", lambda: f"std::{word()}", lambda: f"{word()}::{word()}",
        lambda: f"{word()} ({word()}) {word()}", lambda: f"{word()}&&&", lambda: f"{word()}***", lambda: f"{word()}$$$", lambda: "| " + " | ".join(some(r.randint(1, 5)) for _ in range(3)) + " |",
    ]
    lead = {"email": ["email", "mail", "write to"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "credit card"], "phone": ["tel", "phone", "call", "fax"]}
    table = []
    for _ in range(n):
        tokens, labels = [], []

        def add(text: str, kind: str | None = None) -> None:
            new = text.split()
            tokens.extend(new)
            labels.extend(["O"] * len(new) if kind is None else [f"B-{kind}", *[f"I-{kind}"] * (len(new) - 1)])

        for _ in range(r.choice([r.randint(0, 4), r.randint(6, 16)])):
            add(r.choice([word(), word(), word().title(), word() + r.choice(".,;:")]))
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            kind = r.choice(KINDS)
            if r.random() < 0.3:
                add(r.choice(lead[kind]) + r.choice(["", ":"]))
            add(r.choice(made[kind])(), kind)
            if r.random() < 0.2:
                tokens[-1] += r.choice(".,;")
            for _ in range(r.randint(0, 2)):
                add(word())
        for _ in range(r.choice([0, 1, 2])):
            add(r.choice(alike)())
            for _ in range(r.randint(0, 3)):
                add(word())
        if tokens:
            table.append((tokens, labels))
    return table


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the labelled table; the same in every process."""
    number = {x: k for k, x in enumerate(LABELS)}
    table = labelled_table()
    keys = [[token_key(t) for t in tokens] for tokens, _ in table]
    return train([[_features(k, j) for j in range(len(k))] for k in keys], [[number[x] for x in y] for _, y in table], len(LABELS))


class Decoder:
    """Labels whole texts: all words of a text, however many, are one chain, whose best path Viterbi finds.

    A word whose own scores favour O by more than all that any neighbours' labels could win back is O on
    the best path whatever they are. Words that could only be O or INNER, and lose by INNER even between
    others of it, are O as well where the losses between them and the next word of more choice exceed what the ends
    of such a stretch could win. All these words cut the chain without changing its best path, so that only the
    stretches between them advance, those of equal length together.
    """

    def __init__(self, field: Field) -> None:
        self.field = field
        self.known = {name.lstrip("-")[1:] for name in field.index}
        before = np.vstack([field.pair, field.first])
        behind = np.hstack([field.pair, np.zeros((len(LABELS), 1))])
        #: By how much neighbours can favour each label over O at most.
        self.reach = (before - before[:, :1]).max(0) + (behind - behind[:1]).max(1)
        pair, w = field.pair, INNER
        #: What a word wins by INNER between others of it; what the ends of a stretch of it win at most.
        self.inside = pair[w, w] - pair[0, 0]
        self.ends = self.reach[w] - self.inside
        #: Whether a stretch of nothing but INNER, between words that are O, wins nothing by its ends.
        self.alone = pair[0, w] + pair[w, 0] - 2 * pair[0, 0] <= self.inside
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.kinds: dict[tuple[str, ...], int] = {}
        # what a word adds to the score two before, one before, itself, one behind, two behind; row 0 is the end of a text
        self.table = np.zeros((5, 1024, len(LABELS)))
        for s, at in ((2, 0), (1, 1), (-1, 3), (-2, 4)):
            self.table[at, 0] = self.field.emission([f"{s}end"])

    def _row(self, token: str) -> int:
        key = tuple(f if f in self.known else "" for f in token_key(token))
        row = self.kinds.get(key)
        if row is None:
            row = self.kinds[key] = len(self.kinds) + 1
            if row == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.table[:, row] = [self.field.emission([f"{s}{f}" for f in key]) for s in (2, 1, 0, -1, -2)]
        if len(token) <= 64:
            self.words[token] = row
        return row

    def rows(self, text: str) -> np.ndarray:
        """The table's row of every word of a text."""
        parts = []
        for a, b in _stretches(text):
            tokens = text[a:b].split()
            found = list(map(self.words.get, tokens))
            if None in found:
                # looked up again, as a new word may come more than once
                found = [self.words.get(t) or self._row(t) if k is None else k for k, t in zip(found, tokens)]
            parts.append(np.array(found, np.int32))
            if len(self.words) > MEMORY:
                self.words.clear()
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def _scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The labels' scores of the words at places of ids, of any shape."""
        t = self.table
        return t[2, ids[at]] + t[1, ids[at + 1]] + t[3, ids[at - 1]] + t[0, ids[at + 2]] + t[4, ids[at - 2]]

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, label) of every word that is not O; ids are rows of texts, with two zeros before, between and behind them."""
        cut, loss = np.ones(len(ids), bool), np.zeros(len(ids))
        far = self.ends + 1
        for a in range(2, len(ids) - 2, WORDS_AT_ONCE):
            at = np.arange(a, min(a + WORDS_AT_ONCE, len(ids) - 2))
            e = self._scores(ids, at)
            out = e[:, :1] - e > self.reach
            out[:, 0] = True
            lose = e[:, 0] - e[:, INNER] - self.inside
            few = out[:, :INNER].all(1) & out[:, INNER + 1 :].all(1) & (lose > 0) & self.alone
            sure = out.all(1)
            cut[at] = sure | (ids[at] == 0)
            loss[at] = np.where(ids[at] == 0, 0.0, np.where(sure, far, np.where(few, lose, 0.0)))
        # losses up to each word from the last one of more choice, or the text's end, and back from the next
        total, choice = np.cumsum(loss), loss == 0
        from_last = total - np.maximum.accumulate(np.where(choice, total, 0.0))
        to_next = np.minimum.accumulate(np.where(choice, total, np.inf)[::-1])[::-1] - total + loss
        cut |= ~choice & (from_last > self.ends) & (to_next > self.ends)
        edge = np.flatnonzero(cut[1:] != cut[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        order = np.argsort(ends - starts, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        places, labels, k = [], [], 0
        while k < len(starts):
            n = int(lengths[k])
            stop = min(int(np.searchsorted(lengths, n, "right")), k + max(1, LINKS_AT_ONCE // n))
            part = starts[k:stop]
            path = self._best(ids, part, n)
            row, link = np.nonzero(path)
            places.append(part[row] + link), labels.append(path[row, link])
            k = stop
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int8)
        at, y = np.concatenate(places), np.concatenate(labels)
        order = np.argsort(at)
        return at[order], y[order]

    def _best(self, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Viterbi over stretches of n words between words that are O or the ends of texts."""
        pair, rows = self.field.pair, np.arange(len(starts))
        score = np.where((ids[starts - 1] == 0)[:, None], self.field.first, pair[0])
        back = np.empty((n - 1, len(starts), len(LABELS)), np.int8)
        step = max(1, WORDS_AT_ONCE // len(starts))
        for a in range(0, n, step):
            e = self._scores(ids, starts[:, None] + np.arange(a, min(a + step, n)))
            for j in range(e.shape[1]):
                if a + j:
                    every = score[:, :, None] + pair
                    back[a + j - 1] = every.argmax(1)
                    score = every.max(1)
                score = score + e[:, j]
        score = score + np.where((ids[starts + n] == 0)[:, None], 0.0, pair[:, 0])
        path = np.empty((len(starts), n), np.int8)
        path[:, -1] = score.argmax(1)
        for j in range(n - 2, -1, -1):
            path[:, j] = back[j][rows, path[:, j + 1]]
        return path


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text of about SPLIT characters, cut at blanks."""
    a = 0
    while a < len(text):
        m = _BLANK.search(text, a + SPLIT) if len(text) - a > SPLIT else None
        b = m.end() if m else len(text)
        yield a, b
        a = b


def _places(text: str, wanted: list[int]) -> dict[int, tuple[int, int]]:
    """(start, end) of some words of a text, by their numbers, which rise."""
    out, first, k = {}, 0, 0
    for a, b in _stretches(text):
        if k == len(wanted):
            break
        words = [m.span() for m in _TOKEN.finditer(text, a, b)]
        while k < len(wanted) and wanted[k] < first + len(words):
            out[wanted[k]] = words[wanted[k] - first]
            k += 1
        first += len(words)
    return out


_SPELLED = r"(?:\s?[(\[]{0}[)\]]\s?|\s{0}\s)"
_EMAIL_LIKE = re.compile(r"[^\s@]+(?:@|" + _SPELLED.format("at") + r")[^\s@]+?(?:\.|" + _SPELLED.format("dot") + r")[^\s@]*[A-Za-z]", re.I)
_PHONE_LIKE = re.compile(r"[0-9+(][\x20()./0-9-]*[0-9]")
_CARD_LIKE = re.compile(r"[0-9](?:[\x20./-]?[0-9])+")


def _plausible(kind: str, text: str) -> bool:
    if kind == "email":
        return bool(_EMAIL_LIKE.fullmatch(text))
    if kind == "card":
        return bool(_CARD_LIKE.fullmatch(text)) and _card(text)
    if kind == "phone":
        return bool(_PHONE_LIKE.fullmatch(text)) and _phone(text) and not text.isdigit()
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def _spans_of(text: str, base: list[Span], words: np.ndarray, labels: np.ndarray) -> list[Span]:
    """The plausible spans of a text's words that have labels, but for those that overlap base ones."""
    found, k = [], 0
    number, label = words.tolist(), labels.tolist()
    while k < len(number):
        end = k + 1
        if label[k] % 2:  # else an I without its B
            while end < len(number) and number[end] == number[end - 1] + 1 and label[end] == label[k] + 1:
                end += 1
            found.append((KINDS[label[k] // 2], number[k], number[end - 1]))
        k = end
    if not found:
        return []
    where = _places(text, sorted({w for _, a, b in found for w in (a, b)}))
    held, out = sorted((a, b) for _, a, b in base), []
    starts, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    for kind, first, last in found:
        a, b = where[first][0], where[last][1]
        a += len(text[a:b]) - len(text[a:b].lstrip("\"'«[<"))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_TAIL + ">"))
        k = bisect_left(starts, b)  # of the base spans that start before b, does one end behind a?
        if _plausible(kind, text[a:b]) and not (k and reach[k - 1] > a):
            out.append((kind, a, b))
    return out


def find_spans(docs: list[str], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text; code points, end exclusive, by kind and start."""
    if len(decoder.kinds) > MEMORY:
        decoder._forget()
    base = [base_spans(t) for t in docs]
    rows = [decoder.rows(t) for t in docs]
    gap = np.zeros(2, np.int32)
    at, label = decoder.paths(np.concatenate([gap, *(x for r in rows for x in (r, gap))]))
    starts = np.cumsum([2, *(len(r) + 2 for r in rows)])
    cuts = np.searchsorted(at, starts).tolist()
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    out = []
    for k, (t, b) in enumerate(zip(docs, base)):
        part = slice(cuts[k], cuts[k + 1])
        added = _spans_of(t, b, at[part] - starts[k], label[part]) if cuts[k] < cuts[k + 1] else []
        out.append((b, sorted({*b, *added}, key=order) if added else b))
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: the id, spans (array of kind, start, end), and which of them the patterns found (base).

    Starts and ends are code points, ends exclusive. The patterns' spans always stay; the field adds spans
    that overlap none of them and look like their kind. It decodes every word of a text as one chain, across
    lines; a very long text comes alone and is split into words in parts, which changes nothing. Null and empty texts
    have no spans; rows may repeat, and each is described; ids may be null; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    field = field or default_field()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for piece in pieces(batches, "text"):
            found = find_spans(texts(piece, "text"), decoder)
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x[side]] for x in found], pa.list_(span)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), *lists], ["id", "base", "spans"])

    item = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"id {kind}, base {item}, spans {item}").withColumnRenamed("id", id_col)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; counts and digest of the patterns' spans, all spans spelled out."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
