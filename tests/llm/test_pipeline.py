import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from ledgerline.llm import common, decontamination, quality_classifier

from .test_decontamination import semi_global
from .test_line_dedup import brute as brute_lines
from .test_simhash_dedup import brute as brute_groups


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(3)
    words = [a + b for a in "ba co di fu ge ha ki lo mu ne".split() for b in "rt st lm nd ck th sp ll ss nk".split()] + "the of and in a is to be with".split() * 6
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(25)) for i in range(4)]
    rows = []
    for i in range(50):
        rows.append((i, "\n".join(say(25) + "." for _ in range(6))))
    rows += [(60 + i, f"{rows[i][1][:-4]} zed.") for i in range(4)]
    rows += [(70 + i, "\n".join(["Shared footer line of this site number 7", say(40) + ".", items[i][1], say(30) + "."])) for i in range(4)]
    rows += [(80 + i, " ".join(w.upper() + "!!" for w in say(60).split())) for i in range(20)]
    rows += [(110, None), (111, ""), (112, rows[7][1]), (None, say(50) + ".")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, "en", "s", None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_run_against_brute_force(spark, made):
    d, rows, items = made
    model = quality_classifier.train(spark.read.parquet(f"{d}/documents.parquet"))
    rows = [x for x in rows if model.scores([(x[1] or "").encode()])[0] >= 0.5]
    assert {x[0] for x in rows} == {*range(50), *range(60, 64), *range(70, 74), 112, None}
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    assert dict(rows)[112] == ""
    first = {}
    for i, _, c in brute_groups([((-1 if i is None else i), t) for i, t in rows]):
        first[i] = c
    rows = [(i, t) for i, t in rows if first[-1 if i is None else i] == (-1 if i is None else i)]
    norm = [decontamination.normalise(t) for _, t in items]
    rows = [(i, t) for i, t in rows if not any(semi_global(x, decontamination.normalise(t)) <= decontamination.budget(len(x), 0.1, 1) for x in norm)]
    assert not {70, 71, 72, 73} & {i for i, _ in rows}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(e := sp.encode(t)), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in rows]
    assert sorted((tuple(x) for x in cp.run(spark, d).collect()), key=str) == sorted(want, key=str)


def test_stages_keep_columns_and_take_empty_tables(spark, made):
    d, _, _ = made
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id = -5")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 0, name
    assert cp.STAGES[-1][1](spark, docs, d).collect() == []
    assert 4 <= len(cp.STAGES) <= 5


def test_repeated_rows_leave_one(spark, made):
    d, _, _ = made
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "zz yy"), (None, "zz yy")], "doc_id long, text string")
    assert sorted((tuple(r) for r in cp.one_of_each_group(spark, docs, d).collect()), key=str) == [(1, "a b c"), (None, "zz yy")]


def test_short_lines_go_too(spark):
    rows = [(1, "All rights reserved.\nabcdefgh\none"), (2, "abcdefgh\ntwo\n\nAll  rights reserved."), (3, "\nPage 4\nthree"), (4, "Page 5\n\nfour")]
    out = cp.without_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(i, t) for i, t, _, _ in brute_lines(rows)]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert dict(want) == {1: rows[0][1], 2: "two\n", 3: rows[2][1], 4: "\nfour"}


def test_every_template_of_a_leaf_goes(spark):
    w = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    forms = ["was closed by {} for the night", "may not open until {} says so", "will be sold to {} next year"]
    say = lambda i: "the old shop here " + (forms[i % 3].format(w[i]) if i < 30 else " ".join(w[(i * k + k * k) % 50] for k in range(1, 7)))
    rows = [(i, f"{w[i]} alone\n{say(i)}") for i in range(50)]
    got = dict(tuple(r) for r in cp.without_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == {i: t if i < 3 or i >= 30 else f"{w[i]} alone" for i, t in rows}


def test_columns_of_any_name(spark, made):
    d, rows, _ = made
    names = ["_quality", "_hits", "_n_lines", "_n_dropped", "_key", "_row", "_text", "h", "root", "a.b", "fp", "_least"]
    docs = spark.createDataFrame([(i, t, f"v{i}", *range(len(names))) for i, t in rows[:50:3] + [(112, rows[7][1])]], f"doc_id long, text string, extra string, {', '.join(f'`{n}` int' for n in names)}")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r)[3:] == tuple(range(len(names))) and r.extra == f"v{r.doc_id}" for r in got), name
    assert cp.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_tables_between_stages_are_deleted(spark, made, tmp_path, monkeypatch):
    d, _, _ = made
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = cp.run(spark, d)
    assert [p.name.split("-")[0] for p in (tmp_path / "ledgerline").iterdir()] == ["stage4"]
    assert out.count() > 40


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from ledgerline.llm.common import shared_dir

    session = lambda master, place=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, x=None: place, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=lambda: SimpleNamespace(get=lambda k, x=None: None)))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[8]")).startswith("file:")
