import random

import corpus_pipeline as cp
from ledgerline.llm import shingle_links as m

from .test_simhash_dedup import brute as brute_groups


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) >= 0.8 * len(a | b) > 0


def planted():
    """Texts with near copies of 1 to 6 changed words, in groups of 2 to 7."""
    r = random.Random(4)
    vocab = [f"Word{i}" for i in range(900)]
    rows = []
    for i in range(120):
        t = [r.choice(vocab) for _ in range(r.randrange(90, 200))]
        for _ in range(1 + r.choice([0, 1, 1, 6])):
            c = list(t)
            for _ in range(r.randrange(1, 4)):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append((len(rows), " ".join(c)))
    return rows + [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "a  b\nc")]


def groups(rows, pairs):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_links_are_right_and_find_planted_copies(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r.h: i for i, r in enumerate(df.selectExpr("xxhash64(text) h").collect())}
    got = {tuple(sorted((at[r.a], at[r.b]))) for r in m.similar_links(df).collect()}
    want = {(j, i) for i in range(len(rows)) for j in range(i) if alike(rows[i][1] or "", rows[j][1] or "")}
    assert got <= want
    assert len(want) > 150
    assert groups(rows, got) == groups(rows, want)


def test_stage_drops_near_copies(spark):
    rows = [x for x in planted() if x[0] < 900]
    left = {r.doc_id for r in cp.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    pairs = [(j, i) for i in range(len(rows)) for j in range(i) if alike(rows[i][1], rows[j][1])]
    near = [(i, c) for i, _, c in brute_groups(rows)]
    assert len({*groups(rows, near)}) > len({*groups(rows, near + pairs)})
    pairs += near
    assert left == {*groups(rows, pairs)}
    assert len(left) < len(rows) - 90
