import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerline.llm import language_id as m
from ledgerline.llm.queries import op5_language_id

SF = "/root/testdata/sf0.001"


def plain_ranked(text, size):
    """The most frequent n-grams as strings, words in blanks, by dictionary."""
    spaced = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    c = Counter()
    words = spaced.split()
    for i, w in enumerate(words):
        c.update(w)
        bounded = f" {w} "
        c.update(bounded[j : j + 2] for j in range(len(bounded) - 1))
        c.update(bounded[j : j + 3] for j in range(len(bounded) - 2))
    point = lambda g: [0] * (3 - len(g)) + [2**21 - 1 if x == " " else ord(x) for x in g]
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], point(x[0])))][:size]


def spelt(code):
    places = [code >> 42 & 2**21 - 1, code >> 21 & 2**21 - 1, code & 2**21 - 1]
    return "".join(" " if x == 2**21 - 1 else chr(x) for x in places if x)


def test_ranking_against_dictionaries():
    r = random.Random(4)
    texts = ["".join(r.choice("abcé  \n1日Z") for _ in range(r.randrange(0, 80))) for _ in range(200)] + ["", " ", "a", "A", "1", "a" * 5000]
    got = m.ranked(texts, 50)
    for t, g in zip(texts, got):
        assert [spelt(x) for x in g.tolist()] == plain_ranked(t, 50)


def test_no_two_letters_are_one():
    for a, b in ("eр", "qя", "ñф", "人入", "م日"):
        assert len(set(m.ranked([a], 9)[0]) & set(m.ranked([b], 9)[0])) == 0
    letters = [chr(c) for c in range(0x4E00, 0x9FFF) if chr(c).isalpha()]
    assert len(m.ranked([" ".join(letters)], 1 << 20)[0]) == 4 * len(letters)


def test_distance_against_definition():
    r = random.Random(6)
    say = lambda: "".join(r.choice("abcd рст 日") for _ in range(30))
    own = {k: say() for k in "xyz"}
    model = m.Profiles({k: m.ranked([t], 20)[0] for k, t in own.items()}, 20)
    for text in [say() for _ in range(60)] + ["ab", "zz"]:
        g = plain_ranked(text, 20)
        d = {k: sum(min(abs(p.index(c) - i), 20) if c in p else 20 for i, c in enumerate(g)) for k, p in ((k, plain_ranked(t, 20)) for k, t in own.items())}
        best = min(d, key=lambda k: (d[k], k))
        assert model.predict([text]) == (([best], [1 - d[best] / (20 * len(g))]) if g else (["und"], [0.0]))


def test_learned_profiles_against_dictionaries(spark):
    rows = [(1, "ein Haus und ein Hund", "de"), (2, "der Hund ist alt", "de"), (3, "дом и собака", "ru"), (4, None, "ru"), (5, "x", None)]
    df = spark.createDataFrame(rows, "_key long, _text string, _lang string")
    got = m.learn(df, 30, 10)
    assert {k: [spelt(x) for x in v.tolist()] for k, v in got.items()} == {"de": plain_ranked("ein Haus und ein Hund der Hund ist alt", 30), "ru": plain_ranked("дом и собака", 30)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op5_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (None, "the the", None), (6, "x " * 20000, None), (6, "x " * 20000, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in m.language_id(df, F.col("doc_id") == 99).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[5][0] == "fr"
    assert m.language_id(df.where("doc_id = 77"), F.lit(False)).collect() == []
    assert {r.lang_pred for r in m.language_id(df, F.lit(True)).collect()} == {"und"}
