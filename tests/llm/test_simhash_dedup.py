import random
import re

import numpy as np
import xxhash

from ledgerline.llm import simhash_dedup as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, fps[i] - (fps[i] >> 63 << 64), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in m.simhash_components(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"Word{i}" for i in range(500)]
    rows = []
    for i in range(40):
        t = [r.choice(vocab) for _ in range(300)]
        rows.append((len(rows), " ".join(t)))
        for _ in range(r.choice([0, 0, 3])):
            t = list(t)
            t[r.randrange(300)] = r.choice(vocab)
            rows.append((len(rows), "\n".join(t).upper()))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "a b c"), (905, "a b c"), (None, "a b c"), (None, "é à ü ñ ß"), (906, "z " * 5000)]
    assert run(spark, rows) == brute(rows)


def test_slabs_of_bits(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 3, 4, 5, 50, 7, 200, 6, 4, 0, 9)]
    for rows in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(m, "BIT_ROWS", rows)
        assert m.fingerprints_of([t.encode() for t in texts]).tolist() == [brute_fp(t) for t in texts]


def test_chain_is_one_component(spark):
    fps = [0, 0b1111, 0b11111111, 0b111111111111, 1 << 63, (1 << 63) | 0b1111 << 20, (2**64 - 1) ^ 0b11]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {tuple(r) for r in m.components(m.links(df, 4, 6)).collect()}
    assert {x for x, _ in got} == {int(np.uint64(f).view(np.int64)) for f in fps[:6]}
    assert len({y for _, y in got}) == 1


def test_stars_find_every_link():
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(20):
            x = c
            for b in r.integers(0, 64, int(r.integers(0, 7))).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    own = np.array(fps, np.uint64)
    old, m.SLAB = m.SLAB, 5000
    edges = {tuple(e) for h in range(64) for e in m.stars(own, h, 6, 2).tolist()}
    m.SLAB = old
    link = {f: f for f in fps}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 4
        link[find(a)] = find(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                assert find(a) == find(b)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", 5, "b"), (2, "a", 6, "c")], "doc_id long, text string, fp int, component_id string") == brute([(1, "a"), (2, "a")])
