"""Token counts of whole texts; huge documents by overlap resynchronisation.

A document of more than ``chunk_chars`` characters is encoded in overlapping
chunks with offsets. Two neighbours are spliced at an offset in their overlap
where both encodings have a token boundary and which is proven stable: a
whitespace marker follows another character there, and no piece of the
vocabulary crosses that (checked once for a model). Tokens between two such
offsets are those of the whole text. If an overlap holds no such offset it is
doubled until it does, or until the next chunk swallows the rest. Memory for a
document is its text and a few chunks, whatever its length, unless it has no
white space. Shorter documents are one chunk. With a model whose pieces cross
markers no offset is proven, and every text is encoded whole.

Defined results: null counts as empty text: 0 bytes, 0 tokens, under any limit.
Null ids and repeated rows are counted like others, extra columns are ignored
whatever their names, an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .pieces import MARK, load, separate, text_runs


_by_id: dict[object, np.ndarray] = {}


def _widths(sp, chunk: str) -> np.ndarray:
    """Bytes of the text under each token of a chunk (a marker is one space)."""
    if sp not in _by_id:
        own = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        _by_id[sp] = np.array([1 if sp.is_byte(i) else len(p.encode()) - 2 * p.count(MARK) for i, p in enumerate(own)], np.int64)
    ids = np.array(sp.encode(chunk, num_threads=1), np.int64)
    if not (ids == sp.unk_id()).any():
        return _by_id[sp][ids]
    return np.array([len(p.encode()) - 2 * p.count(MARK) for p in sp.encode(chunk, out_type=str, num_threads=1)], np.int64)


class _Encoded:
    """A chunk text[lo:hi] with the byte offsets from lo where its tokens end."""

    def __init__(self, sp, text: str, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        widths = _widths(sp, text[lo:hi])
        # the library puts one marker in front of the chunk, which the text lacks
        self.count, self.ends = len(widths), np.cumsum(widths) - 1

    def upto(self, byte: int) -> int | None:
        """Tokens that end at ``byte`` or before, if a token ends there."""
        k = int(np.searchsorted(self.ends, byte, "right"))
        return k if k and self.ends[k - 1] == byte else None


def huge_count(sp, text: str, chunk_chars: int = 1 << 12, overlap_chars: int = 256) -> int:
    """len(sp.encode(text)) from overlapping chunks."""
    text = text.replace(MARK, " ")
    total, taken = 0, 0  # tokens so far; tokens of the current chunk that precede it
    now = _Encoded(sp, text, 0, min(chunk_chars, len(text)))
    while now.hi < len(text):
        overlap = overlap_chars
        while True:
            lo = max(now.lo, now.hi - overlap)
            cuts = [i for i in range(now.hi - 1, lo, -1) if text[i] == " " and text[i - 1] != " "]
            nxt = _Encoded(sp, text, lo, min(lo + max(chunk_chars, 2 * overlap), len(text))) if cuts else None
            spliced = False
            for i in cuts:
                a, b = now.upto(len(text[now.lo : i].encode())), nxt.upto(len(text[lo:i].encode()))
                if a is not None and b is not None and a >= taken:
                    total += a - taken
                    now, taken, spliced = nxt, b, True
                    break
            if spliced:
                break
            if lo == now.lo:  # nothing to splice at in this chunk: encode twice as far
                now = _Encoded(sp, text, now.lo, min(2 * now.hi - now.lo, len(text)))
                if now.hi == len(text):
                    break
            else:
                overlap *= 2
    return total + now.count - taken


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = 1 << 12, overlap_chars: int = 256) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``df``."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        sp, proven = load(model), separate(model)
        texts = b.column(1).to_pylist()
        out = np.zeros(len(texts), np.int64)
        for lo, hi in text_runs(texts):
            short = [i for i in range(lo, hi) if len(texts[i]) <= chunk_chars or not proven]
            out[short] = [len(x) for x in sp.encode([texts[i] for i in short], num_threads=1)]
            for i in set(range(lo, hi)).difference(short):
                out[i] = huge_count(sp, texts[i], chunk_chars, overlap_chars)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out)], ["_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(docs, count, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
