import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import pieces
from ledgerline.llm.piece_codec import encode_decode
from ledgerline.llm.token_counts import huge_count, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = [None, "", " ", "  ", "a", " a  b ", "▁x▁▁y", "<s> </s> <unk> <0x41>", "日本語 😀 é", "tab\tand\nline\r\n", "\0", "the quick " * 3000, "nospace" * 3000, "x" * 40 + " " * 300 + "y", " " * 999]
text = st.text(alphabet=st.sampled_from(list("aeth  \n▁é日😀0<>")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text)
def test_word_table_and_splices_equal_the_library(t):
    table = pieces.word_table(MODEL)
    words = pieces.marked_words(t)
    table.add([words])
    assert table.gather(table.codes(words)).tolist() == SP.encode(t)
    if len(t) > 6:
        assert huge_count(SP, t, 6, 2) == len(SP.encode(t))


def rows(spark):
    return spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in enumerate(TEXTS)] + [(None, "a b", 1, "x", None), (3, "dup", 1, "", None), (3, "dup", 1, "", None)], "doc_id long, text string, n_tokens int, decoded string, ids array<int>")


def test_token_counts(spark):
    for kw in ({}, {"chunk_chars": 100, "overlap_chars": 4}):
        got = sorted((tuple(r) for r in token_counts(rows(spark), MODEL, limit=100, **kw).collect()), key=str)
        want = [(r.doc_id, len((r.text or "").encode()), n := len(SP.encode(r.text or "")), n > 100) for r in rows(spark).collect()]
        assert got == sorted(want, key=str)


def test_encode_decode(spark):
    got = sorted((tuple(r) for r in encode_decode(rows(spark), MODEL).collect()), key=str)
    want = [(r.doc_id, i := SP.encode(r.text or ""), SP.decode(i)) for r in rows(spark).collect()]
    assert got == sorted(want, key=str)


def test_small_table_is_refilled():
    table = pieces.WordTable(SP, 5)
    for t in ("a b c d", "c d e f g", "h a b c d e f"):
        w = pieces.marked_words(t)
        table.add([w])
        assert table.gather(table.codes(w)).tolist() == SP.encode(t)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(df, MODEL).collect() == [] and encode_decode(df, MODEL).collect() == []


def test_resynchronisation_at_default_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 4096").select("doc_id", "text")
    long = [r.text for r in docs.collect()]
    assert len(long) > 1000 and max(map(len, long)) > 100_000
    made = ["word " * 40000, "one  two   three\n" * 9000, "x" * 70000 + " y" * 9000, " " * 9000 + "a b" * 5000, "日本 語▁é😀 " * 8000, "ab" * 2100 + " " + "cd" * 30000]
    assert [huge_count(SP, t) for t in made] == [len(SP.encode(t)) for t in made]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, MODEL).collect()}
    assert got == {r.doc_id: len(SP.encode(r.text)) for r in docs.collect()}


def test_most_chunks_are_spliced(monkeypatch):
    from ledgerline.llm import token_counts as m

    spans = []
    real = m._Encoded
    monkeypatch.setattr(m, "_Encoded", lambda sp, t, lo, hi: spans.append(hi - lo) or real(sp, t, lo, hi))
    text = "The quick brown fox, it is said, jumps over the lazy dog. " * 5000
    assert m.huge_count(SP, text) == len(SP.encode(text))
    assert max(spans) == 4096 and sum(spans) < 1.1 * len(text)
