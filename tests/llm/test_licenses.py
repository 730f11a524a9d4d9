import random

import pytest

from flowlens.llm.licenses import NOTICES, Scanner, bigrams, full_texts, license_scan, op1_license_scan, templates


def brute(unit, table, least):
    b = bigrams(unit)
    best = None
    for name, text in table:
        t = bigrams(text)
        dice = 2 * len(b & t) / (len(b) + len(t)) if b and t else 0
        if dice >= least and (best is None or (-dice, name) < (-best[0], best[1])):
            best = dice, name
    return best


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_bounds_lose_nothing(least):
    table = templates()
    units = [t for _, t in table] + [" ".join(t.split()[::2]) for _, t in table] + [" ".join(t.split()[: len(t.split()) * 3 // 4]) for _, t in table] + [t + " and some other words" for _, t in table] + ["", "one", "license", "the the the the"]
    scanner = Scanner(table, least)
    for u in units:
        assert scanner.match(u) == brute(u, table, least)


def test_rows(spark, tmp_path):
    mit = NOTICES["MIT"]
    rows = [(1, "Released under the MIT License.\nother text of the day"), (2, mit), (3, "intro\n\n" + mit.replace(". ", ".\n") + "\n\noutro"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0"), (6, "released UNDER the mit license\nReleased under the MIT License."), (6, "x"), (7, "word " * 200_000)]
    spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, matches string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_matches, r.licenses, r.best_dice) for r in op1_license_scan(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 1, "MIT", 1.0), (2, 1, "MIT", 1.0), (3, 2, "MIT", 1.0), (4, 0, "", 0.0), (5, 0, "", 0.0), (None, 1, "CC-BY-NC-4.0", 1.0), (6, 3, "MIT", 1.0), (6, 0, "", 0.0), (7, 0, "", 0.0)], key=repr)
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert license_scan(spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string"), table=[]).first().matches == []


PROSE = " ".join(f"On day {k} the committee spoke of bridge {k * 7} and of river {k * 13}." for k in range(60))


@pytest.fixture(scope="module")
def scanner():
    return Scanner(templates() + full_texts(), 0.8)


def test_licences_across_paragraphs_behind_prose(scanner):
    mit = NOTICES["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    assert mit.count("\n\n") == 2
    for text in (f"{PROSE}\n\n{mit}\n\n{PROSE}", f"{PROSE} {mit} {PROSE}", f"{PROSE}\n" + "\n".join(mit.split(" ")) + f"\n{PROSE}"):
        # the notice's last two pairs of words stand in it before
        assert scanner.scan(text) == [(1.0, "MIT", text[text.index("Permission") : text.index("DEALINGS") + 11])]


def test_sentences_within_a_line(scanner):
    text = "This project is released under the MIT License."
    assert scanner.match(text) is None and scanner.scan(text) == [(1.0, "MIT", "released under the MIT License")]
    assert [(k, u) for _, k, u in scanner.scan(f"{PROSE} Licensed under CC BY-NC 4.0; parts are distributed under the ISC License. {PROSE}")] == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("ISC", "distributed under the ISC License")]


@pytest.mark.parametrize("name, text", full_texts())
def test_whole_licences(scanner, name, text):
    assert scanner.match(text) == (1.0, name)
    words = text.split()
    inside = scanner.scan(f"{PROSE}\n" + " ".join(words[:-4]) + f" {PROSE}")
    assert name in {k for _, k, _ in inside} and max(len(bigrams(u)) for _, k, u in inside if k == name) > 0.9 * len(bigrams(text))


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_windows_equal_brute_force(least):
    r, some = random.Random(3), 0
    table = [("A", "a b c d e f"), ("B", "b c a a d"), ("C", "f e d c b a f a e")]
    scanner = Scanner(table, least)
    for _ in range(80):
        words = r.choices("abcdefxyz", k=r.randint(0, 40))
        for name, t in r.choices(table, k=r.randint(0, 2)):
            words[(at := r.randint(0, len(words))) : at] = t.split()
        text = " ".join(words)
        best = max((m[0] for s in range(len(words)) for e in range(s + 2, len(words) + 1) if (m := brute(" ".join(words[s:e]), table, least))), default=0)
        for name, t in table:
            one = Scanner([(name, t)], least).windows(text, words, bigrams(text), [])
            top = max((m[0] for s in range(len(words)) for e in range(s + 2, len(words) + 1) if (m := brute(" ".join(words[s:e]), [(name, t)], least))), default=0)
            assert max((x[0] for x in one), default=0) == top
        found = scanner.windows(text, words, bigrams(text), [])
        assert bool(found) == (best > 0) and all(brute(u, table, least) and 2 * len(bigrams(u) & bigrams(dict(table)[k])) / (len(bigrams(u)) + len(bigrams(dict(table)[k]))) == d for d, k, u in found)
        some += best > 0
    assert some > 20


def test_many_places_in_one_text(scanner):
    found = scanner.scan("so it is released under the MIT License. " * 5_000)
    assert len(found) == 5_000 and {x[1] for x in found} == {"MIT"}
