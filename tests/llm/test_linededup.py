"""Word-level line dedup against brute force, in several scripts and with unequal lines."""

from __future__ import annotations

import random

import pytest

from eventframe.llm import linededup

ALPHABETS = {"latin": "abcdehinorsty", "latin without d and y": "abcehinorst", "upper": "ABCEHINORST", "digits": "0123456789",
             "greek": "αβγδεζηθικλ", "arabic": "ابتثجحخدذرز", "cyrillic": "абвгдежзик", "cjk": "一二三四五六七八九"}


def brute(texts, run=50):
    """doc -> the words that stay, by comparing every window of ``run`` words with all windows at earlier places."""
    seen, out = {}, {}
    for i in sorted(texts):
        words = [(w, p) for p, line in enumerate(texts[i].split("\n")) for w in line.split()]
        gone = set()
        for s in range(len(words) - run + 1):
            key = tuple(w for w, _ in words[s:s + run])
            place = (i, words[s][1])
            if seen.setdefault(key, place) != place:
                gone.update(range(s, s + run))
        out[i] = [w for k, (w, _) in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("name", ALPHABETS)
def test_passages_in_the_middle_of_lines(spark, name):
    rng = random.Random(name)
    word = lambda: "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(3, 8)))
    words = lambda n: [word() for _ in range(n)]

    def laid(ws):
        """Words joined by spaces and, here and there, line breaks."""
        return "".join(w + rng.choice([" "] * 9 + ["\n", "  ", " \n "]) for w in ws)

    passages = [words(rng.choice([50, 51, 60, 75, 76, 200])) for _ in range(20)]
    texts = {i: laid(words(rng.randrange(0, 30)) + p + words(rng.randrange(0, 30))) for i, p in enumerate(passages)}
    for i, p in enumerate(passages):
        cut = p[:25] + words(1) + p[25:] if i % 5 == 4 else p       # every fifth copy is interrupted
        texts[100 + i] = laid(words(rng.randrange(0, 30)) + cut + words(rng.randrange(0, 30)))
        texts[200 + i] = laid(words(7) + p[rng.randrange(10):] + words(5))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(df).collect()}
    assert {i: t.split() for i, t in got.items()} == brute(texts)
    assert all(got[i] == texts[i] for i in range(20))


def test_families_with_changed_words(spark):
    """Copies of one text with words changed at random: a fingerprint's first place goes on differently than later ones."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = {}
    for i in range(60):
        ws = [f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base]
        a = rng.randrange(100)
        texts[i] = " ".join(ws[a:a + rng.randrange(60, 300)])
    texts[70] = texts[9]
    texts[71] = "\n".join([" ".join(base[:12])] * 30)
    texts[72] = "again " * 400
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"].split() for r in linededup.without_repeated_lines(df).collect()}
    assert got == brute(texts)


def test_white_space_around_runs(spark):
    run = " ".join(f"r{i}" for i in range(60))
    texts = {0: run, 1: f"a b {run} c", 2: f"d e {run}\nf g", 3: f"h\n{run}\ni", 4: f"{run}\n\nj", 5: f" k \n\n{run}", 6: run + "\n", 7: f"l\n{run}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["_llm_deleted"]) for r in linededup.without_repeated_lines(df).collect()}
    assert got == {0: (run, 0), 1: ("a b c", 0), 2: ("d e\nf g", 0), 3: ("h\ni", 1), 4: ("j", 2), 5: (" k", 2), 6: ("", 2), 7: ("l", 1)}


def test_column_expressions_only(spark, capsys):
    """No step of the job runs Python on the executors."""
    run = " ".join(f"r{i}" for i in range(60))
    df = spark.createDataFrame([(0, run), (1, f"a {run}"), (2, None)], "doc_id long, text string")
    linededup.without_repeated_lines(df).explain()
    linededup.stretches(df).explain()
    plans = capsys.readouterr().out
    assert "Generate" in plans and not any(x in plans for x in ("Python", "Arrow", "Pandas"))


def test_all_kinds_of_white_space(spark):
    """Every white space that str.split knows parts words, also before and behind a text; other letters near them do not."""
    words = [f"r{i}\u200b" for i in range(60)]
    spaces = linededup.SPACES
    laid = "".join(w + spaces[i % len(spaces)] for i, w in enumerate(words))
    texts = {0: " ".join(words), 1: f"\u2003 {laid}", 2: f"\u3000\x1ca \u1680{laid}b\u2028", 3: f"{laid}\x85", 4: " \u2009 ", 5: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(df).collect()}
    assert {c for c in map(chr, range(0x3100)) if c.isspace()} == set(spaces)
    assert got == {0: texts[0], 1: "", 2: "\u3000\x1ca \u1680b\u2028", 3: "", 4: texts[4], 5: ""}


def test_texts_are_fingerprinted_once(spark, monkeypatch):
    """One pass over the texts gives the places of repeated fingerprints."""
    calls, real = [], linededup.stretches
    monkeypatch.setattr(linededup, "stretches", lambda *args: calls.append(1) or real(*args))
    run = " ".join(f"r{i}" for i in range(60))
    df = spark.createDataFrame([(0, run), (1, f"a {run}")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(df).collect()} == {0: run, 1: "a"}
    assert len(calls) == 1


def test_a_few_words_on_and_on(spark):
    """Fingerprints of a few words said on and on are dealt apart, so that they are no large group, and the results stay whole."""
    rng = random.Random(4)
    texts = {}
    for i, period in enumerate([1, 1, 2, 3, 5, 8, 13, 13, 20]):
        words = [f"w{period}x{k}" for k in range(period)] * (400 // period)
        texts[i] = " ".join([f"own{i}", *words[rng.randrange(period):], f"end{i}"])
        texts[100 + i] = "\n".join(" ".join(words[k:k + 40]) for k in range(0, 200, 40))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = linededup.stretches(df).collect()
    short = [r for r in rows if r["id"] % 100 < 8 and 1 <= r["at"] < 300 and r["id"] < 100]
    assert short and all(r["apart"] for r in short)
    assert len({r["apart"] for r in short}) == len(short)
    assert not any(r["apart"] for r in rows if r["id"] % 100 == 8)
    got = {r["doc_id"]: r["text"].split() for r in linededup.without_repeated_lines(df).collect()}
    assert got == brute(texts)


def test_first_places_come_with_the_fingerprints(spark, monkeypatch):
    """The shuffle that tells repeated fingerprints gives first places and differing stretches too; only places apart are grouped again."""
    rows, real = {}, linededup.stored

    def counted(df, purpose):
        out = real(df, purpose)
        rows[purpose] = out.count()
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = {0: " ".join(words), 1: " ".join(["a", *words, "b"]), 2: "\n".join([" ".join(words[:100]), "c", " ".join(words[:100])]), 3: " ".join(words[:170] + ["d"] + words[171:])}
    texts[4] = " ".join(rng.choice(words) for _ in range(200))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"].split() for r in linededup.without_repeated_lines(df).collect()}
    assert got == brute(texts)
    assert rows["places"] > 0 and rows["first-places"] == rows["later-places"] == 0
    again = spark.createDataFrame([(0, "on and " * 100), (1, "x " + "on and " * 100)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(again).collect()}[1] == "x"
    assert rows["first-places"] > 0


def test_runs_of_overlapping_places(spark):
    """A window found inside a longer stretch neither ends a run nor begins one."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {0: " ".join(base), 1: " ".join(["x", *base[:60], *base[5:58], *base[40:], "y", *base[10:90]]), 2: " ".join(base[:55] + ["z"] * 3 + base[50:]),
             3: " ".join([*base[:70], *(["q"] * 49), *base[20:75], *(["r"] * 50), *base[60:]]), 4: " ".join(base[30:110] * 3)}
    df = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, texts[0])], "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], tuple(r["text"].split())) for r in linededup.without_repeated_lines(df).collect()]
    want = brute({-1: texts[0], **texts})
    assert set(got) == {(None if i == -1 else i, tuple(w)) for i, w in want.items()} and len(got) == 7
