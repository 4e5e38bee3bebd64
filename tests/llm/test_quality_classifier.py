import math
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import quality_classifier as m
from ledgerline.llm.queries import op7_quality_classifier

SF = "/root/testdata/sf0.01"


def test_labels_agree(spark):
    got = op7_quality_classifier(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    keep = {r.doc_id: r.keep for r in got.collect()}
    good, bad = [d for d, q in lab.items() if q == 1], [d for d, q in lab.items() if q == 0]
    assert sum(keep[d] for d in good) >= 0.99 * len(good)
    assert sum(not keep[d] for d in bad) >= 0.95 * len(bad)


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20000) < 0.7
    right = [0.9, 0.8, 0.7, 0.85, 0.75]
    v = np.stack([np.where(r.random(20000) < 0.3, 0, np.where((r.random(20000) < a) == truth, 2, 1)) for a in right], axis=1)
    pats, counts = np.unique(v, axis=0, return_counts=True)
    prior, answers, post = m.expectation_maximisation(pats, counts)
    assert abs(prior - 0.7) < 0.03
    for j, a in enumerate(right):
        assert abs(answers[j, 1, 2] / answers[j, 1, 1:].sum() - a) < 0.03
    at = {tuple(p): x for p, x in zip(pats.tolist(), post)}
    assert np.mean([(at[tuple(x)] >= 0.5) == t for x, t in zip(v.tolist(), truth)]) > 0.9


def test_statistics_of_plain_cases():
    n, s = m.statistics([b"", b"the THE the cat!!", b"a b a b a b", b"A | B | C", "é $$$ x.".encode()])
    row = dict(zip(m.STATISTICS, s[1]))
    assert n.tolist() == [0, 4, 6, 5, 3]
    assert row["bang_share"] == 0.25 and row["repeat_share"] == 0.5 and row["distinct_share"] == 0.5 and row["function_share"] == 0.75
    assert dict(zip(m.STATISTICS, s[2]))["loop_share"] == 1 - 2 / 5
    assert dict(zip(m.STATISTICS, s[3]))["bare_share"] == 0.4
    assert not s[0].any()


def test_odd_rows(spark):
    r = random.Random(1)
    words = "the of and in a to cat house garden green river stone walked quickly bread window paper yellow".split()
    clean = [(i, " ".join(r.choice(words) + ("." if j % 9 == 8 else "") for j in range(60)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(r.choice(words).upper() + "!!" for _ in range(60))) for i in range(30)]
    rows = clean + junk + [(200, None), (201, ""), (202, " \n"), (203, clean[0][1]), (203, clean[0][1]), (None, clean[1][1]), (204, clean[2][1] * 500), (205, "ok")]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, quality string, keep int")
    got = {x.doc_id: (x.quality, x.keep) for x in m.quality(df).collect()}
    assert all(got[d] == (0.0, False) for d in (200, 201, 202))
    assert all(got[d][1] for d, _ in clean) and not any(got[d][1] for d, _ in junk)
    assert got[203][0] == got[0][0] and got[None][0] == got[1][0]
    assert m.quality(df.where("doc_id = 999")).collect() == []
    assert m.quality(df.where("doc_id < 50")).where(F.col("keep")).count() == 50


SOLO = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]
STOPS, BANGS = ".!?,;:。，、！？；：،؟؛۔।॥።፣", "!！"


def plain_tokens(text):
    alnum = lambda c: unicodedata.category(c)[0] in "LNM"
    solo = lambda c: alnum(c) and any(a <= ord(c) <= b for a, b in SOLO)
    out, before = [], " "
    for c in text:
        if not c.isspace():
            if before.isspace() or solo(c) or solo(before) and alnum(c):
                out.append("")
            out[-1] += c
        before = c
    return out


def plain_statistics(text):
    t = plain_tokens(text)
    low = ["".join(c.lower()[0] if unicodedata.category(c)[0] in "LNM" else c for c in w) for w in t]
    n, kind = max(1, len(t)), [unicodedata.category(c) for c in text]
    up, down = kind.count("Lu"), kind.count("Ll")
    symbols = sum(33 <= ord(c) < 128 and not c.isalnum() and c not in ".,;:!?'\"()-" or ord(c) > 127 and k in ("Sm", "So", "Sk") for c, k in zip(text, kind))
    pairs = list(zip(low, low[1:]))
    known = set(m.FUNCTION_WORDS)
    latin = sum(k[0] == "L" and (ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00) for c, k in zip(text, kind))
    letters = sum(k[0] in "LNM" for k in kind)
    return {
        "upper_share": up / max(1, up + down),
        "symbol_share": symbols / max(1, sum(not c.isspace() for c in text)),
        "distinct_share": min(1.0, len(set(low)) / min(n, 4 * math.sqrt(n))),
        "repeat_share": sum(a == b for a, b in pairs) / n,
        "loop_share": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        "bare_share": sum(not any(unicodedata.category(c)[0] in "LNM" for c in w) for w in t) / n,
        "bang_share": sum(w[-1] in BANGS for w in t) / n,
        "function_share": sum(w in known for w in low) / n if 2 * latin >= letters else -1.0,
        "stop_share": sum(w[-1] in STOPS for w in t) / n,
    }


def plain_votes(n, stats):
    def vote(x, below, above, lo, hi, one):
        v = 2 if lo is not None and lo <= x - 2 * one and x <= hi else 0
        if below is not None and x < below * (1 - 24 * one) or above is not None and x - 2 * one > above:
            v = 1
        return v

    out = []
    for _, name, *limits in m.LABELLERS:
        x = stats[name]
        v = vote(x, *limits, 0.0)
        out.append(v if n and x >= 0 and v == vote(x, *limits, 1 / n) else 3)
    return tuple(out)


def plain_em(patterns):
    votes = {p: c for p, c in Counter(patterns).items() if 1 in p or 2 in p}
    post = {p: (p.count(2) + 0.5) / (p.count(2) + 2 * p.count(1) + 1) for p in votes}
    for _ in range(200):
        prior = min(0.99, max(0.01, sum(c * post[p] for p, c in votes.items()) / sum(votes.values())))
        table = []
        for j in range(len(m.LABELLERS)):
            rows = []
            for good in (False, True):
                seen = [0.1 + sum(c * (post[p] if good else 1 - post[p]) for p, c in votes.items() if p[j] == v) for v in range(3)]
                rows.append([x / sum(seen) for x in seen])
            table.append(rows)
        odds = {p: plain_odds(p, prior, table) for p in votes}
        new = {p: 1 / (1 + math.exp(-o)) for p, o in odds.items()}
        if max(abs(new[p] - post[p]) for p in votes) < 1e-9:
            break
        post = new
    return prior, table


def plain_odds(p, prior, table):
    o = math.log(prior / (1 - prior))
    if 1 in p or 2 in p:
        o += sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(p) if v < 3)
    return max(-30, min(30, o))


def plain_score(model, text, prior, table):
    n = len(plain_tokens(text))
    if not n:
        return 0.0
    stats, b = plain_statistics(text), text.encode()
    z = model.bias
    for j, name in enumerate(m.STATISTICS):
        level = min(15, max(0, int(stats[name] * 16)))
        z += 0.5 * model.weights[0x9E37 * (j * 16 + level + 1) % 65536]
    slots = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2)]
    if slots:
        z += 8 * sum(float(model.weights[s]) for s in slots) / len(slots)
    z = (n * z + 8 * plain_odds(plain_votes(n, stats), prior, table)) / (n + 8)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


ODD = ["", " \n", "BUY!! NOW!!", "a", "a|b | c", "好" * 40, "今天天气很好，我们去公园散步。孩子们在草地上玩耍，老人坐在长椅上聊天。", "Он пришёл домой поздно вечером, и никто его не встретил.", "ทดสอบ ข้อความ", "x\u3000y\u00a0z", "İstanbul ŞEHİR", "\u0130\ufeff\u200d 😀😀"]


def test_whole_table_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text or "" for r in docs.collect()]
    n, stats = m.statistics([t.encode() for t in texts + ODD])
    votes = m.votes(n, stats)
    for i, t in enumerate(texts + ODD):
        plain = plain_statistics(t)
        assert n[i] == len(plain_tokens(t))
        if n[i]:
            assert [round(x, 9) for x in stats[i]] == [round(plain[s], 9) for s in m.STATISTICS], t
            assert tuple(votes[i].tolist()) == plain_votes(int(n[i]), plain), t
    model = m.train(docs)
    prior, table = plain_em([plain_votes(len(plain_tokens(t)), plain_statistics(t)) for t in texts])
    assert abs(model.prior - prior) < 1e-6 and np.allclose(model.answers, table, atol=1e-6)
    got = sorted((r.text or "", r._quality) for r in m.score(docs, model).collect())
    want = sorted((t, plain_score(model, t, prior, table)) for t in texts)
    assert all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, want)) and len(got) == len(want)


def test_labellers_in_other_scripts():
    def votes(t):
        v = m.votes(*m.statistics([t.encode()]))[0]
        return {x[0]: k for x, k in zip(m.LABELLERS, v.tolist())}

    clean = "今天天气很好，我们去公园散步。孩子们在草地上玩耍，老人坐在长椅上聊天。傍晚的时候，天边出现了美丽的晚霞，大家都拿出手机拍照。回家的路上，我买了一些水果和牛奶，准备明天的早餐。"
    v = votes(clean)
    assert v["punctuation"] == 2 and 1 not in v.values() and v["function_words"] == m.UNTOLD
    assert votes("买买买！！" * 30)["loops"] == 1
    russian = votes("Он пришёл домой поздно вечером, и никто его не встретил. В комнате было темно, только часы тихо стучали на стене. Утром все проснулись рано и пошли в лес за грибами.")
    assert 1 not in russian.values() and russian["function_words"] == m.UNTOLD
    assert votes("КУПИ СЕЙЧАС ДЁШЕВО ТОЛЬКО СЕГОДНЯ")["shouting"] == 1
    assert votes("ab | cd | ef | gh | ij | kl | mn | op | qr")["separators"] == 1


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some words of a text.", 2, 3, 4)], "doc_id long, text string, _quality int, _row int, `a.b` int")
    out = m.score(df, m.train(df), score_col="q")
    assert out.columns == [*df.columns, "q"] and tuple(out.first())[:5] == tuple(df.first())
