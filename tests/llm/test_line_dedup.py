import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import line_dedup as module
from ledgerline.llm.line_dedup import line_dedup


def brute(rows, depth=4, min_tokens=1):
    """Plain Python version over rows (id, text) with distinct ids, null first."""
    parsed, docs = {}, defaultdict(set)
    order = lambda d: (d is not None, d or 0)
    for d, text in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            t = ["<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r")) if w]
            if len(t) >= max(1, min_tokens):
                m = " ".join(t)
                parsed[d, p] = m
                docs[m].add(d)
    firsts = defaultdict(list)
    groups = defaultdict(list)
    for m in docs:
        t = m.split(" ")
        if len(t) > depth:
            leaf = len(t), tuple(t[:depth])
            groups[leaf].append(m)
            for i in range(depth, len(t)):
                groups[leaf, i, t[i]].append(m)
    for ms in groups.values():
        pairs = sum(len(docs[m]) for m in ms)
        if len(ms) < 2 or pairs < 3:
            continue
        n = ms[0].count(" ") + 1
        form = {}
        for i in range(depth, n):
            c = Counter()
            for m in ms:
                c[m.split(" ")[i]] += len(docs[m])
            tok, hits = min(c.items(), key=lambda x: (-x[1], x[0]))
            if hits >= 0.5 * pairs:
                form[i] = tok
        met = [m for m in ms if form and sum(form.get(i) == w for i, w in enumerate(m.split(" "))) >= 0.6 * (n - depth)]
        owners = set().union(*(docs[m] for m in met))
        if len(owners) >= 3:
            for m in met:
                firsts[m].append(min(owners, key=order))
    for m, s in docs.items():
        if len(s) >= 2:
            firsts[m].append(min(s, key=order))
    first = {m: min(x, key=order) for m, x in firsts.items()}
    out = []
    for d, text in rows:
        ls = text.split("\n") if text is not None else []
        gone = [p for p in range(len(ls)) if (m := parsed.get((d, p))) in first and order(d) > order(first[m])]
        out.append((d, None if text is None else "\n".join(x for p, x in enumerate(ls) if p not in gone), len(ls), len(gone)))
    return sorted(out, key=str)


ROWS = [(i, f"unique line number {'abcdefghij'[i]} here for you\nShared boiler plate line is here\nLogin at {i * 7}:{i} by some user now\nwe saw the brown {w} jump over the fence today") for i, w in enumerate("fox dog cat cow hen".split())]
ROWS += [(10, "x\ny"), (11, None), (12, ""), (None, "  Shared\tboiler  plate line is here \nshort one"), (13, "a b c d e " * 500 + "\n\n\n"), (14, "solo line one two three\nsolo line one two three"), (15, "é à ü ñ ß ç"), (16, "é à ü ñ ß ç")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 3) for r in ROWS], "doc_id long, text string, m string, doc string, p int")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "_n_lines", "_n_dropped").collect()), key=str)
    assert got == brute(ROWS)
    assert {tuple(r) for r in out.select("doc", "p").collect()} == {("k", 3)}


def test_repeated_rows_are_one_document_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the very same line of text")] * 3 + [(2, "the very same line of text")], "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup(df).select("doc_id", "_n_dropped").collect()) == [(1, 0), (1, 0), (1, 0), (2, 1)]
    assert line_dedup(df.where("doc_id > 9")).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup(df).where(F.col("_n_dropped") > 0).count()


def test_short_lines_and_distinct_documents(spark):
    rows = [(i, f"All rights reserved.\nRead more here\n{'abcdefghij'[i]} own") for i in range(10)]
    rows += [(20, "we sold the old red house to him\nwe sold the old blue house to him"), (21, "we sold the old green house to him")]
    rows += [(30, "they took the old red house from him\nthey took the old blue house from him"), (31, "they took the old green house from him"), (32, "they took the old tall house from him")]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute(rows)
    dropped = {r[0]: r[3] for r in got}
    assert [dropped[i] for i in range(10)] == [0] + [2] * 9
    assert dropped[20] == dropped[21] == 0  # a template of two documents, whatever its variants
    assert [dropped[i] for i in (30, 31, 32)] == [0, 1, 1]


def test_random_leaves_against_brute_force(spark):
    r = random.Random(8)
    say = lambda: "a b c d " + " ".join(r.choice("pqrst") for _ in range(r.choice([1, 3, 5])))
    rows = [(i, "\n".join(say() for _ in range(r.randrange(4)))) for i in range(60)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x) for x in out.collect()), key=str) == brute(rows)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x y", 1, 2, 3), (2, "x y", 4, 5, 6)], "doc_id long, text string, _n_lines int, doc int, `a.b` int")
    out = line_dedup(df, counts=("l", "d"))
    assert out.columns == [*df.columns, "l", "d"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x y", 1, 2, 3, 1, 0), (2, "", 4, 5, 6, 1, 1)]


def test_many_leaves_against_brute_force(spark):
    r = random.Random(21)
    rows, n = [], 0
    letters = "pqrstuvwxyz"
    for leaf in range(120):
        t, kinds, words = r.choice([2, 4, 8, 12]), r.choice([3, 8, 20, 40]), letters[: r.choice([2, 4, 11])]
        forms = [[r.choice(words) for _ in range(t)] for _ in range(r.choice([1, 2, 3]))]
        for _ in range(kinds):
            base = r.choice(forms) if r.random() < 0.8 else [r.choice(letters) for _ in range(t)]
            line = [w if r.random() < r.choice([0.7, 0.9]) else r.choice(letters) for w in base]
            name = "".join(chr(97 + int(c)) for c in str(leaf))
            rows.append((r.choice([n, r.randrange(5000, 5400)]), f"leaf {name} of tree " + " ".join(line)))
            n += 1
    texts = {}
    for i, line in rows:
        texts[i] = texts[i] + "\n" + line if i in texts else line
    rows = sorted(texts.items())
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got, want = sorted((tuple(x) for x in out.collect()), key=str), brute(rows)
    assert sum(x[3] for x in want) > 300 and got == want


def dealt(plan):
    """Rows that the generators of a plan that has run have made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(dealt(plan.children().apply(i)) for i in range(plan.children().size()))


def test_tokens_of_groups_are_counted_where_their_lines_meet(spark, monkeypatch):
    r = random.Random(5)
    lines = ["a b c d " + " ".join(r.choice("pq" if r.random() < 0.9 else "rst") for _ in range(12)) for _ in range(40)]
    groups = [r.sample(range(40), r.randrange(2, 41)) for _ in range(40)]
    rows = [(1, 2, g, lines[i], 16, 1 + i % 3, sum(1 + j % 3 for j in own), len(own)) for g, own in enumerate(groups) for i in own]
    df = spark.createDataFrame(rows, "leaf1 long, leaf2 long, grp long, m string, n int, docs long, pairs long, kinds long")
    tail = F.slice(F.split("m", " "), 5, F.col("n") - 4)

    def forms(limit):
        monkeypatch.setattr(module, "GROUP_TOKENS", limit)
        out = module._forms(df, tail, 4, 0.5, 0.6)
        return sorted((x.grp, x.form) for x in out.collect()), dealt(out._jdf.queryExecution().executedPlan())

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        (some, few), (same, all_), (mixed, _) = forms(1 << 16), forms(0), forms(200)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {}
    for g, own in enumerate(groups):
        form = []
        for p in range(4, 16):
            c = Counter()
            for i in own:
                c[lines[i].split()[p]] += 1 + i % 3
            tok, hits = min(c.items(), key=lambda x: (-x[1], x[0]))
            form.append(tok if hits >= 0.5 * c.total() else None)
        if 12 - form.count(None) >= 0.6 * 12:
            want[g] = form
    assert some == same == mixed == sorted(want.items()) and want
    assert few == len(want) and all_ == 12 * len(rows)
