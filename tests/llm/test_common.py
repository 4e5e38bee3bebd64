import random

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from ledgerline.llm import common, piece_codec, pieces
from ledgerline.llm import quality_classifier as q
from ledgerline.llm.queries import tokenizer_model


def test_slices_hold_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 4000, 1, 0, 900, 70_000, 3)] + [None, "é"] * 400
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    nested = pa.RecordBatch.from_arrays([rows.to_struct_array()], ["row"])
    for limit in (1, 300, 5000, 1 << 30):
        for b in (rows, nested, rows.slice(3, 50), rows.slice(0, 0)):
            got = list(common.slices([b, b], limit))
            assert [x for g in got for x in g.to_pylist()] == 2 * b.to_pylist()
    assert len(list(common.slices([rows], 5000))) > 8
    assert len(list(common.slices([rows], 1 << 30))) == 1


def test_the_scorer_gets_no_whole_batch(spark):
    """The largest run of texts that the scorer gets, of one batch."""
    r = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(400))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sum(len(t) for _, t in rows)
    model = q.Model(q.np.zeros(q.DIMS), 0.0, 0.5, q.np.full((len(q.LABELLERS), 2, 3), 1 / 3))
    model.scores = lambda texts: q.np.full(len(texts), float(sum(map(len, texts))))
    most = max(x._quality for x in q.score(docs, model).collect())
    assert 0 < most < whole / 3


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_score_reads_the_text_of_its_row(spark, kind):
    docs = spark.createDataFrame([("a", "one", 1), (None, None, 2), ("b", "é three", 3)], "Other string, text string, n long").withColumn("text", cp.F.col("text").cast(kind))
    model = q.Model(q.np.zeros(q.DIMS), 0.0, 0.5, q.np.full((len(q.LABELLERS), 2, 3), 1 / 3))
    model.scores = lambda texts: q.np.array([float(len(t)) for t in texts])
    got = {x.n: (x.Other, x.text if kind == "string" or x.text is None else x.text.decode(), x._quality) for x in q.score(docs, model).collect()}
    assert got == {1: ("a", "one", 3.0), 2: (None, None, 0.0), 3: ("b", "é three", 8.0)}


def test_a_task_leaves_no_words_in_its_worker():
    model = tokenizer_model()
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["_id", "_text"])
    for _ in range(2):
        out = list(piece_codec._coder(model)([batch]))
        assert [x for b in out for x in b.column(1).to_pylist()] == pieces.load(model).encode(texts)
        assert not pieces.word_table(model).at
