"""Leak search against brute force over folded words, with damage."""

import random

from tidewatch.llm import leaks
from tidewatch.llm.subtitles import fold, words

WORDS = "harbor lantern window captain ferry morning letter silver orchard violin bakery stone river market candle garden winter coins bridge kettle señora después fenêtre Straße brücke école".split()
DOC = "doc_id long, text string, item_id string, run_words int"
ITEM = "item_id long, text string, doc_id int"


def sentence(rnd, n):
    return [rnd.choice(WORDS) + rnd.choice(["", "", "", "a", "u"]) for _ in range(n)]


def cues(ws, rnd):
    out, i, n = [], 0, 1
    while i < len(ws):
        k = rnd.choice([4, 6, 9])
        line = " ".join(ws[i : i + k])
        out.append(f"{n}\n00:00:{n % 60:02d},000 --> 00:01:00,000\n{rnd.choice(['', '<i>', '[door creaks] ', '♪ la la ♪ ', '- '])}{line.capitalize()}{rnd.choice(['', '.', '!', '...'])}")
        i, n = i + k, n + 1
    return "\r\n\r\n".join(out)


def brute(docs, items, least):
    found = set()
    for d, t in docs:
        w = words(t or "")
        for i, it in items:
            x = fold(it or "").split()
            long = 0
            row = [0] * (len(x) + 1)
            for a in w:
                new = [0] * (len(x) + 1)
                for j, b in enumerate(x):
                    if a == b:
                        new[j + 1] = row[j] + 1
                        long = max(long, new[j + 1])
                row = new
            if long >= least:
                found.add((d, i))
    return found


def search(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], DOC)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], ITEM)
    return {(r.doc_id, r.item_id): r.run_words for r in leaks.leaked(d.repartition(2), i, **kw).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(sentence(rnd, 40))) for i in range(30)]
    docs = []
    for d in range(120):
        w = sentence(rnd, rnd.choice([5, 60, 400]))
        for _ in range(rnd.choice([0, 1, 2])):
            x = rnd.choice(items)[1].split()
            n = rnd.choice([8, 13, 14, 15, 16, 30])
            a = rnd.randrange(len(x) - n + 1)
            p = rnd.randrange(len(w) + 1)
            w = w[:p] + x[a : a + n] + w[p:]
        docs.append((d, cues(w, rnd)))
    got = search(spark, docs, items)
    assert set(got) == brute(docs, items, 15) and got


def test_damage(spark):
    text = "the captain hid the silver lantern after the second bell because nobody in the village remembered the école française près du pont"
    items = [(1, text)]
    damaged = text.replace("captain", "captairi").replace("hid", "hicl").replace("lantern", "1antem").replace("remembered", "rernernbered")
    variants = [text.upper(), damaged, text.encode().decode("cp1252"), text.encode("cp1252").decode("cp1251"), text.encode("ascii", "replace").decode(), text.replace("village", "viillage"), "﻿" + text.replace(" ", "\n")]
    got = search(spark, list(enumerate(variants)), items)
    assert {d for d, _ in got} == set(range(len(variants)))


def test_music_signs_in_any_encoding_and_sharp_s():
    from tidewatch.llm.subtitles import words

    want = words("der Mann vergaß die Laterne")
    for sign in ("♪", "â™ª", "â\x99ª", "?", "♪".encode().decode("cp1251")):
        assert words(f"der Mann vergaß\n{sign} langsame Musik {sign}\ndie Laterne") == want, sign
        assert words(f"der Mann\n- {sign} langsame Musik {sign} vergaß\ndie Laterne") == want, sign
    assert words("DER MANN VERGASS DIE LATERNE") == want
    assert words("Is it 55 or 5?\nYes?") == words("is it 55 or 5 yes") and len(words("it cost 55")) == 3


def test_short_or_reordered_echoes_are_none(spark):
    rnd = random.Random(8)
    x = [f"word{i}x" for i in range(40)]
    items = [(1, " ".join(x))]
    docs = [(1, " ".join(x[:14])), (2, " ".join(x[:10] + ["other"] + x[10:20])), (3, " ".join(rnd.sample(x, 40))), (4, " ".join(x[3:18]))]
    assert set(search(spark, docs, items)) == {(4, 1)}


def test_descriptions_of_any_length_and_open_brackets():
    from tidewatch.llm.subtitles import words

    long = " ".join(["rumbling"] * 30)
    want = words("der Mann geht heim")
    for a, b in ("[]", "()", "**", "##", "♪♪"):
        assert words(f"der Mann {a}{long}{b} geht heim") == want, a
    assert words(f"der Mann\n♪ {long} ♪\ngeht heim") == words(f'der <font face="{long}">Mann</font> geht heim') == want
    assert words("der Mann [leise\nMusik] geht heim") == want
    assert words("der [Mann\n\n7\n00:00:01,000 --> 00:00:02,000\ngeht] heim") == want
    assert words("[" * 50_000 + "x") == ["x"] and words("(a" * 50_000) == ["a"] * 50_000


def test_a_changed_word_ends_a_run(spark):
    x = [f"harbor{c}" for c in "abcdefghij"] + "in 1984 the house stood near water".split() + [f"garden{c}" for c in "abcde"]
    changed = {"1984": "1985", "house": "horse", "water": "wafers"}
    docs = [(i, " ".join(x[:14]) + f" {w}") for i, w in enumerate(["horses", "houze"])] + [(9, " ".join(changed.get(w, w) for w in x)), (10, " ".join(x))]
    assert set(search(spark, docs, [(1, " ".join(x))])) == {(10, 1)}


def test_nulls_empties_long_texts_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_CHARS", 10)
    monkeypatch.setattr(leaks, "BLOCKS_A_PASS", 2)
    x = " ".join(f"alpha{i}q" for i in range(20))
    docs = [(1, None), (2, ""), (3, "pad " * 200_000 + x), (None, x), (5, x), (5, x)]
    got = search(spark, docs, [(1, x), (2, None), (3, ""), (4, "two words"), (9, x)])
    assert got == {(3, 1): 20, (3, 9): 20, (None, 1): 20, (None, 9): 20, (5, 1): 20, (5, 9): 20}
    assert search(spark, [], [(1, x)]) == {} and search(spark, docs, []) == {}
