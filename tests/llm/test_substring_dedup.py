import random
import re
from collections import Counter

from ledgerline.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string", **kw):
    return sorted((tuple(r) for r in substring_dedup(spark.createDataFrame(rows, schema), **kw).collect()), key=str)


def make(seed, n, window):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)] + ["é x", " ", "日本"]
    passage = " ".join(r.choice(vocab) for _ in range(window + 20))
    rows = []
    for i in range(n):
        t = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        if r.random() < 0.4:
            t.insert(r.randrange(len(t) + 1), passage)
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\x0b "), (n + 3, "a " * 3000), (n + 4, rows[0][1]), (n + 4, rows[0][1]), (None, "x y z"), (None, None)]
    return rows


def test_against_brute_force(spark):
    for seed, window in ((1, 35), (2, 7), (3, 5)):
        rows = make(seed, 60, window)
        assert run(spark, rows, window=window) == brute(rows, window)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], "doc_id long, text string") == []
    rows = [(1, "a b c d e f", 3, "x", 7), (2, "a b c d e f", 4, "y", 8)]
    got = run(spark, rows, "doc_id long, text string, n_words int, _chunk string, bucket int", window=6)
    assert got == [(1, 6, 6, ""), (2, 6, 6, "")]


def test_all_groups_hot(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(40)) + f" tail{i}") for i in range(300)]
    assert run(spark, rows, window=35) == brute(rows, 35)


def test_heavy_groups_are_dealt_twice(spark):
    import numpy as np

    from ledgerline.llm import substring_dedup as m
    from ledgerline.llm.common import Lexed

    r = random.Random(4)
    rows = [(i, " ".join([f"h{r.randrange(3)}" for _ in range(20)] + ["the same nine words stand here in every text"] + [f"u{r.randrange(4)}" for _ in range(20)])) for i in range(250)]
    for kw in ({}, {"bucket_words": 50}, {"bucket_words": 50, "chunk_words": 500, "sketch_slots": 64}):
        assert run(spark, rows, window=8, **kw) == brute(rows, 8)
    lx = Lexed([rows[0][1].encode()])
    _, one, few = m.super_kmers(lx, 8, np.zeros(64, np.uint8), 1 << 20)
    _, two, more = m.super_kmers(lx, 8, np.full(64, m.HOT | m.HEAVY, np.uint8), 1 << 20)
    assert one.sum() == two.sum() == len(lx) - 7 and len(more) > len(few)


def test_sketch_grows_with_the_table(spark):
    from ledgerline.llm import substring_dedup as m

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    assert m.slots_for(df, 800_000) == 1 << m.LEAST_BITS < m.slots_for(df, 5) <= 1 << m.MOST_BITS == m.slots_for(df, 1)


def test_hash_collisions_are_resolved(spark, monkeypatch):
    import numpy as np

    from ledgerline.llm import substring_dedup as m

    monkeypatch.setattr(m, "mix64", lambda x: x & np.uint64(1))
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9], np.int32)
    at = np.arange(8)
    want = Counter(tuple(ids[i : i + 3]) for i in at)
    assert m._repeated(ids, at, 3).tolist() == [want[tuple(ids[i : i + 3])] > 1 for i in at]
