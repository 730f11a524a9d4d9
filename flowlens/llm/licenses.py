"""License scan: texts, paragraphs, lines and windows of words against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import pieces, texts
from .common import ship

#: Names of licences, by which the short notices are made.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC0-1.0": "CC0 1.0",
}
#: The frames that short notices put around a name.
FRAMES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "Distributed under the {}")
#: Longer notices and short licences, from their public texts.
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORDS)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Words of a window's reach up to which equal places of one text are searched once.
REMEMBERED = 512

Bigrams = frozenset[tuple[str, str]]


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every template."""
    short = [(k, f.format(n)) for k, n in NAMES.items() for f in FRAMES]
    return short + list(NOTICES.items())


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole licences in the folder license_texts, read by the driver."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def _fold(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() else text.lower()


def bigrams(text: str) -> Bigrams:
    words = _WORD.findall(_fold(text))
    return frozenset(zip(words, words[1:]))


class Scanner:
    """Finds the template closest to a unit of text; only templates whose size allows the coefficient are compared."""

    def __init__(self, table: list[tuple[str, str]], least: float) -> None:
        self.least = least
        found = sorted((len(b), name, b) for name, b in {(name, bigrams(text)) for name, text in table} if b)
        self.sizes, self.rows = [x[0] for x in found], found
        self.any = frozenset().union(*(x[2] for x in found)) if found else frozenset()
        self.holders = defaultdict(list)
        for k, (_, _, b) in enumerate(found):
            for pair in b:
                self.holders[pair].append(k)
        self.low, self.high = (self._bounds(self.sizes[0])[0], self._bounds(self.sizes[-1])[1]) if found else (1, 0)

    def _bounds(self, n: int) -> tuple[float, float]:
        """Sizes with which n bigrams can reach the coefficient: 2 min(n, m) / (n + m) >= least."""
        return n * self.least / (2 - self.least) - 1e-9, n * (2 - self.least) / self.least + 1e-9

    def match(self, unit: str, b: Bigrams | None = None) -> tuple[float, str] | None:
        """(coefficient, licence) of the best template at or above least; of equals the first by name."""
        b = bigrams(unit) if b is None else b
        if not self.low <= len(b) <= self.high:
            return None
        shared = len(b & self.any)
        lo, hi = self._bounds(len(b))
        if 2 * shared < self.least * (len(b) + max(lo, self.sizes[0])) - 1e-9:
            return None
        best: tuple[float, str] | None = None
        for n, name, t in self.rows[bisect_left(self.sizes, lo) : bisect_right(self.sizes, hi)]:
            dice = 2 * len(b & t) / (len(b) + n)
            if dice >= self.least and (best is None or (-dice, name) < (-best[0], best[1])):
                best = dice, name
        return best

    def _places(self, k: int, ids: np.ndarray, before: np.ndarray, after: np.ndarray, number: dict) -> list[tuple[float, int, int, int]]:
        """(coefficient, score, first, last bigram) of template k's windows in a text, those of highest coefficient first.

        A window's first and last bigram are the template's and stand in it once: any other window has a
        shorter one at least as close. Of each start the best end counts. Windows that share half of their
        bigrams or more with better ones are left out.
        """
        n, _, template = self.rows[k]
        low, high = self._bounds(n)
        mine = np.zeros(len(number), bool)
        mine[[number[p] for p in template if p in number]] = True
        hit = mine[ids]
        reach, found, known = int(2 * high) + 64, [], {}
        for s in np.flatnonzero(hit).tolist():
            limit = int(after[s])  # beyond it, its first bigram would stand in the window twice
            stop = min(limit, s + reach)
            key = ids[s:stop].tobytes() if reach <= REMEMBERED else None
            best = known.get(key, ()) if key is not None else ()
            if best == ():
                whole = True
                while True:
                    new = before[s:stop] < s
                    size = np.cumsum(new)
                    if stop == limit or size[-1] > high:
                        break
                    whole, stop = False, min(limit, s + 2 * (stop - s))
                size = size[: np.searchsorted(size, high, "right")]
                same = np.cumsum(new[: len(size)] & hit[s : s + len(size)])
                dice = 2 * same / (size + n)
                e = int(dice.argmax())
                best = (float(dice[e]), int(3 * same[e] - size[e]) - n, e) if dice[e] >= self.least else None
                if whole and key is not None:
                    known[key] = best
            if best:
                found.append((*best[:2], s, s + best[2]))
        return _apart(sorted(found, key=lambda w: (-w[0], w[2], w[3])), np.zeros(len(ids), bool))

    def windows(self, text: str, words: list[str], whole: Bigrams, units: list[tuple[float, str, str]]) -> list[tuple[float, str, str]]:
        """(coefficient, licence, window) of the runs of words that match, over line and paragraph breaks and within lines.

        A window that reaches the coefficient holds least / (2 - least) of a template's bigrams, so only
        templates of which the text has as many are looked for. Of windows of several templates that share half
        of their words or more, the one with the most shared bigrams less differing ones stays. A window is left out
        too if half of it lies in units that match the same licence, or any as closely.
        """
        count = Counter(k for pair in whole & self.any for k in self.holders[pair])
        near = [k for k, c in count.items() if c >= self._bounds(self.rows[k][0])[0]]
        if not near:
            return []
        number: dict[tuple[str, str], int] = {}
        ids = np.fromiter((number.setdefault(p, len(number)) for p in zip(words, words[1:])), np.int64, len(words) - 1)
        order = np.argsort(ids, kind="stable")
        twin = ids[order[1:]] == ids[order[:-1]]
        before, after = np.full(len(ids), -1), np.full(len(ids), len(ids))
        before[order[1:][twin]], after[order[:-1][twin]] = order[:-1][twin], order[1:][twin]
        found = [(dice, self.rows[k][1], score, s, e) for k in near for dice, score, s, e in self._places(k, ids, before, after, number)]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(_fold(text))]
        firsts, held = [a for a, _ in spans], []
        matched = {u: (dice, name) for dice, name, u in units}
        for parts, gap in (([text], 0), (text.split("\n\n"), 2), (text.split("\n"), 1)):
            at = 0
            for u in parts:
                if u in matched:
                    held.append((*matched[u], bisect_left(firsts, at), bisect_left(firsts, at + len(u))))
                at += len(u) + gap
        # how close the closest unit around each word is, and by licence whether there is one
        close, same = np.zeros(len(words)), defaultdict(lambda: np.zeros(len(words), bool))
        for dice, name, a, b in held:
            close[a:b] = np.maximum(close[a:b], dice)
            same[name][a:b] = True
        inside = lambda w: ((close[w[3] : w[4] + 2] >= w[0]) | (same[w[1]][w[3] : w[4] + 2] if w[1] in same else False)).mean() >= 0.5
        found = sorted((w for w in found if not inside(w)), key=lambda w: (-w[2], -w[0], w[1], w[3], w[4]))
        return [(w[0], w[1], text[spans[w[3]][0] : spans[w[4] + 1][1]]) for w in sorted(_apart(found, np.zeros(len(ids), bool)), key=lambda w: (w[3], w[4], w[1]))]

    def scan(self, text: str) -> list[tuple[float, str, str]]:
        """(coefficient, licence, unit) of every distinct unit that matches: the text, its paragraphs, its lines; then of the windows."""
        words = _WORD.findall(_fold(text))
        whole = frozenset(zip(words, words[1:]))
        units = dict.fromkeys([text, *text.split("\n\n"), *text.split("\n")])
        found = [(*m, u) for u in units if (m := self.match(u, whole if u is text else None))]
        return found + self.windows(text, words, whole, found)


def _apart(windows: list[tuple], taken: np.ndarray) -> list[tuple]:
    """The windows (..., first, last), best first, without those of which half or more is taken by better ones."""
    out = []
    for w in windows:
        part = taken[w[-2] : w[-1] + 1]
        if 2 * np.count_nonzero(part) < len(part):
            part[:] = True
            out.append(w)
    return out


def license_scan(docs: DataFrame, *, table: list[tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, matches (array of licence, dice, unit).

    A unit is the whole text, a paragraph (between empty lines) or a line; equal units of a text count once.
    Runs of words that match and that no such unit accounts for follow, each place for itself: licences across paragraphs
    or lines, behind other text, or within a line. Units without two words match nothing. The templates are a
    table of a few hundred texts, whole licences among them, in the driver's hands. Null texts are empty; very long ones are read whole, one at a time; rows may repeat and ids be null;
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    table = templates() + full_texts() if table is None else table
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, least)
        for piece in pieces(batches, "text"):
            found = [[{"license": k, "dice": d, "unit": u} for d, k, u in scanner.scan(t)] for t in texts(piece, "text")]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, item)], ["id", "matches"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, matches array<struct<license:string,dice:double,unit:string>>").withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many units match, the licences, the best coefficient (0 where none)."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), best.alias("best_dice"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in templates())
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT DISTINCT name, {pairs} AS b FROM (SELECT name, {words("text")} AS w FROM (VALUES {rows}) v(name, text))),
u AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, coalesce(text, '') AS unit FROM documents UNION ALL
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) FROM documents UNION ALL
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents)
), ub AS (SELECT doc_id, unit, {pairs} AS b FROM (SELECT doc_id, unit, {words("unit")} AS w FROM u) WHERE len(w) > 1),
d AS (
  SELECT doc_id, unit, name, 2 * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) AS dice FROM ub JOIN t
  ON len(t.b) BETWEEN len(ub.b) * 0.8 / 1.2 - 1e-9 AND len(ub.b) * 1.2 / 0.8 + 1e-9
), best AS (
  SELECT doc_id, unit, dice, name FROM d WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, name) = 1
), a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS dice FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, coalesce(dice, 0.0::DOUBLE) AS best_dice FROM documents LEFT JOIN a USING (doc_id)
"""


OP1_SQL = _sql()
