"""SentencePiece encoding and decoding through a distinct-chunk table.

Each distinct marked word is segmented, and its ids decoded, once for a task
(its worker lives on beside later stages, so the table goes); documents join the ids and the texts back by position. That is exact
when pieces cannot cross whitespace markers, which is checked on the model; a
model that fails the check is run over whole texts instead. Rows never move:
there is no shuffle, and memory is bounded by the table's limit.

Defined results: null is encoded as the empty text (no ids, empty decoded
text). Null ids and repeated rows are encoded like others, extra columns are
ignored whatever their names, an empty table gives an empty table. A text is
encoded whole in one task, in memory of some twenty times its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, then_released
from .pieces import load, marked_words, text_runs, word_table


def _decoded(words, text_of: dict[int, str], codes: np.ndarray) -> str:
    """The decoded text: each word's own decoding behind its marker, without
    the marker that the library had put in front of the text."""
    return " ".join(map(text_of.__getitem__, codes.tolist()))


def _coder(model: str):
    def fn(batches):
        words = word_table(model)
        try:
            yield from coded(batches, load(model), words)
        finally:
            if words is not None:
                words.clear()

    def coded(batches, sp, words):
        text_of: dict[int, str] = {}
        table = None
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for lo, hi in text_runs(texts):
                part = texts[lo:hi]
                if words is None:
                    ids = [np.array(x, np.int32) for x in sp.encode(part, num_threads=1)]
                    decoded = [sp.decode(x.tolist()) for x in ids]
                else:
                    split = [marked_words(t) for t in part]
                    words.add(split)
                    if table is not words.at:
                        text_of, table = {}, words.at
                    new = range(len(text_of), len(words.offsets))
                    text_of.update(zip(new, _decode_words(words, new)))
                    codes = [words.codes(w) for w in split]
                    ids = [words.gather(c) for c in codes]
                    decoded = [_decoded(words, text_of, c) for c in codes]
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], ["_id", "ids", "decoded"])

    return fn


def _decode_words(words, new: range) -> list[str]:
    """decode() of each new word's ids (it drops the leading marker)."""
    if not len(new):
        return []
    cut = words.offsets[new.start :].tolist() + [len(words.flat)]
    flat = words.flat
    return words.sp.decode([flat[a:b].tolist() for a, b in zip(cut, cut[1:])])


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids array<int>, decoded string for every row of ``df``."""
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(then_released(_coder(model)), f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of the rows of encode_decode()."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
