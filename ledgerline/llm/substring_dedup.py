"""Exact substring de-duplication over windows of words (super-k-mers).

Every run of consecutive windows that share a minimiser travels as one packed
string to the bucket of that minimiser; a bucket therefore holds every copy of
each of its windows, and sorting the windows there counts them exactly.

How the work is laid out:

1. A count sketch of all m-word groups (one pass, all rows; its size follows
   from the size of the input, up to a bound) marks the few groups that are so
   frequent that they would draw a bucket full of unrelated contexts. The
   minimiser order prefers other groups, so a common line or passage doesn't
   become one hot bucket. Where the minimiser that is left still draws more than
   a bucket's share, its windows are dealt by a second one as well (the largest
   group in the order). The order only decides where a window goes; equal
   windows go to the same place under any order.
2. Documents are dealt to chunks by a hash of the row. A chunk sends each
   distinct super-k-mer once, however many of its documents hold it, so a
   group of copies costs a bucket one string for each chunk, not each document.
3. A bucket sorts 64-bit window hashes and compares neighbours word by word
   (exact; a hash collision is resolved by sorting the word ids themselves).
   It returns one bit for each window that it was sent.
4. The chunk meets its bits again (same exchange, reused) and cuts the words.

Defined results: null and empty texts have no words, nothing is removed and
the kept text is empty. Repeated rows are separate documents: their windows
count against each other. A text shorter than the window keeps all words. Rows
with a null id are treated like any other. Extra input columns are ignored
whatever their names. An empty table gives an empty table. A text is cut in one
task, in memory of some fifty times its length; its windows are counted apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexed, as_bytes, cut, mix64, runs_by_size, shuffle_partitions, then_released

MER = 5
#: The sketch has 2^LEAST_BITS to 2^MOST_BITS slots: a task holds 32 MB of counts,
#: and every task of the closure 4 MB of marks, at most.
LEAST_BITS, MOST_BITS = 16, 22
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("inv", pow(_P, -1, 1 << 64))):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t)
    return _powers["p"], _powers["inv"]


def word_hashes(lx: Lexed) -> np.ndarray:
    """A 64-bit hash of every word, a function of its bytes only."""
    n = len(lx.norm)
    if not len(lx):
        return np.empty(0, np.uint64)
    p, inv = _power_tables(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((lx.norm.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
    return mix64((c[lx.end] - c[lx.start]) * inv[lx.start])


def mer_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the groups of MER words that start at each word."""
    n = len(h) - MER + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for t in range(1, MER):
        out = out * _Q + h[t : t + n]
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, step = x, 1
    while step * 2 <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


HOT, HEAVY = 1, 2


def super_kmers(lx: Lexed, window: int, marks: np.ndarray, buckets: int):
    """(first word, number of windows, bucket) of every super-k-mer. ``marks``
    says of each slot of the sketch whether its groups are HOT or HEAVY."""
    none = np.empty(0, np.int64)
    if len(lx) < window:
        return none, none, none
    mer = mer_hashes(word_hashes(lx))
    mark = marks[mer >> np.uint64(64 - (marks.size.bit_length() - 1))]
    order = mer >> np.uint64(2)
    order |= mark.astype(np.uint64) << np.uint64(62)
    key = sliding_min(order, window - MER + 1)
    ends = np.repeat(lx.first[1:], np.diff(lx.first))
    at = np.flatnonzero(ends[: len(key)] - np.arange(len(key)) >= window)
    if not len(at):
        return none, none, none
    k = key[at]
    heavy = k >> np.uint64(63) > 0  # no lighter group in the window
    if heavy.any():
        second = ~sliding_min(~order, window - MER + 1)[at]
        k = np.where(heavy, mix64(k ^ mix64(second)), k)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (k[1:] != k[:-1]))))
    count = np.diff(np.concatenate((new, [len(at)])))
    bucket = (mix64(k[new]) % np.uint64(buckets)).astype(np.int64)
    return at[new], count, bucket


class _Chunk:
    """Documents of a chunk in a fixed order, and their distinct super-k-mers."""

    def __init__(self, t: pa.Table, window: int, marks: np.ndarray, buckets: int, pack: bool):
        texts = as_bytes(t["_text"])
        ids = t["_order"].to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or "", texts[i]))
        texts = [texts[i] for i in self.order]
        self.parts, self.occ, self.strings = [], [], {}
        self.bucket, self.offset, self.windows, self.seen = [], [], [], []
        self.fill: dict[int, int] = {}
        self.packed: dict[int, list[bytes]] = {}
        strings = self.strings
        for a, b in runs_by_size(texts):
            lx = Lexed(texts[a:b])
            first, count, bucket = super_kmers(lx, window, marks, buckets)
            norm = lx.norm.tobytes()
            lo, hi = lx.start[first].tolist(), lx.end[first + (count + window - 2)].tolist() if len(first) else []
            own = []
            for x, y, n, bk in zip(lo, hi, count.tolist(), bucket.tolist()):
                s = norm[x:y]
                g = strings.get(s)
                if g is None:
                    g = strings[s] = len(self.bucket)
                    self.bucket.append(bk)
                    self.windows.append(n)
                    self.seen.append(1)
                    self.offset.append(self.fill.get(bk, 0))
                    self.fill[bk] = self.offset[-1] + n
                    if pack:
                        self.packed.setdefault(bk, []).append(s)
                else:
                    self.seen[g] = 2
                own.append(g)
            if not pack:
                self.parts.append(lx)
                self.occ.append((first, np.array(own, np.int64)))


def _pack(window: int, marks: np.ndarray, buckets: int):
    def fn(t: pa.Table) -> pa.Table:
        chunk = _Chunk(t, window, marks, buckets, True)
        z = zstandard.ZstdCompressor(level=3)
        bks = sorted(chunk.packed)
        blobs = [z.compress(b"\n".join(chunk.packed[b])) for b in bks]
        key = t["_chunk"][0].as_py()
        return pa.table({"bucket": pa.array(bks, pa.int32()), "chunk": pa.array([key] * len(bks), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return fn


def _repeated(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each window start in ``at``: does its sequence of ids occur at another?"""
    h = mix64(ids.astype(np.uint64) + np.uint64(1))
    parts, have, step, done, rest = [], h, 1, 0, window
    while rest:  # hash of `window` ids from doubling blocks
        if rest & 1:
            parts.append((done, have))
            done += step
        rest >>= 1
        if rest:
            have = mix64(have[:-step] * _Q + have[step:]) if len(have) > step else have[:0]
            step *= 2
    total = np.zeros(len(at), np.uint64)
    for off, x in parts:
        total = mix64(total * _Q + x[at + off])
    order = np.argsort(total)
    s, pos = total[order], at[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    out = np.zeros(len(at), bool)
    if not len(same):
        return out
    good = np.ones(len(same), bool)
    for lo in range(0, len(same), 1 << 16):
        part = same[lo : lo + (1 << 16)]
        a, b = pos[part], pos[part + 1]
        for c in range(window):
            good[lo : lo + len(part)] &= ids[a + c] == ids[b + c]
    out[order[same[good]]] = True
    out[order[same[good] + 1]] = True
    if not good.all():  # different windows under one hash: sort those by their ids
        bad = np.unique(s[same[~good]])
        for value in bad:
            members = order[s == value]
            rows = np.stack([ids[at[members] + c] for c in range(window)], axis=1)
            _, inv, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            out[members] = n[inv.ravel()] > 1
    return out


def _count(window: int):
    def fn(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        chunks = t["chunk"].to_pylist()
        blobs = [z.decompress(b) for b in t["blob"].to_pylist()]
        lengths = np.array([len(b) + 1 for b in blobs])
        buf = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8).copy()
        del blobs
        stop = np.flatnonzero(buf == 10)
        sep = np.flatnonzero((buf == 32) | (buf == 10))
        buf[stop] = 32
        words = pa.Array.from_buffers(pa.large_binary(), len(sep), [None, pa.py_buffer(np.concatenate(([0], sep + 1)).astype(np.int64)), pa.py_buffer(buf)])
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        last = np.searchsorted(sep, stop)  # last word of each string
        first = np.concatenate(([0], last[:-1] + 1))
        count = last - first + 2 - window
        base = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        at = base + np.arange(len(base))
        flags = _repeated(ids, at, window)
        edges = np.searchsorted(stop, np.cumsum(lengths) - 1) + 1  # strings up to each blob's end
        upto = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], edges))]
        out = [(c, flags[upto[i] : upto[i + 1]]) for i, c in enumerate(chunks)]
        out = [(c, np.packbits(f).tobytes()) for c, f in out if f.any()]
        key = t["bucket"][0].as_py()
        return pa.table({"_chunk": pa.array([c for c, _ in out], pa.int32()), "bucket": pa.array([key] * len(out), pa.int32()), "bits": pa.array([b for _, b in out], pa.binary())})

    return fn


def _cut_words(window: int, marks: np.ndarray, buckets: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, window, marks, buckets, False)
        base, flags, have = {}, [], 0
        sent = dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist()))
        for bk, n in chunk.fill.items():
            base[bk] = have
            have += n
            flags.append(np.unpackbits(np.frombuffer(sent[bk], np.uint8), count=n).astype(bool) if bk in sent else np.zeros(n, bool))
        flags = np.concatenate(flags) if flags else np.zeros(0, bool)
        where = np.array([base[b] + o for b, o in zip(chunk.bucket, chunk.offset)], np.int64)
        windows = np.array(chunk.windows, np.int64)
        several = np.array(chunk.seen, np.int64) > 1
        n_words, n_removed, kept = [], [], []
        for lx, (first, g) in zip(chunk.parts, chunk.occ):
            cover = np.zeros(len(lx) + 1, np.int32)
            if len(g):
                n = windows[g]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                dup = flags[np.repeat(where[g], n) + step] | np.repeat(several[g], n)
                starts = (np.repeat(first, n) + step)[dup]
                cover[starts] += 1
                cover[starts + window] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            stay = np.repeat(~gone, lx.end - lx.start + 1)
            upto = np.concatenate(([0], np.cumsum(stay)))
            text = lx.norm[stay].tobytes()
            word_byte = np.append(lx.start, len(lx.norm))
            removed = np.concatenate(([0], np.cumsum(gone)))
            for a, b in zip(lx.first[:-1].tolist(), lx.first[1:].tolist()):
                lo, hi = upto[word_byte[a]], upto[word_byte[b]]
                n_words.append(b - a)
                n_removed.append(int(removed[b] - removed[a]))
                kept.append(text[lo : hi - 1] if hi > lo else b"")
        ids = left["_id"].combine_chunks().take(pa.array(chunk.order, pa.int64()))
        return pa.table({"_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return fn


def sketch_groups(docs: DataFrame, slots: int) -> tuple[DataFrame, int]:
    """Counts of all m-word groups by slot (slot, n), and their total."""

    def sketch(batches):
        n = np.zeros(slots, np.int64)
        shift = np.uint64(64 - (slots.bit_length() - 1))
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in runs_by_size(texts):
                m = mer_hashes(word_hashes(Lexed(texts[lo:hi])))
                n += np.bincount((m >> shift).astype(np.int64), minlength=slots)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["slot", "n"])

    counts = docs.select("_text").mapInArrow(then_released(sketch), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = cut(counts, "sketch")
    return counts, counts.agg(F.sum("n")).first()[0] or 0


def marked_groups(counts: DataFrame, total: int, slots: int, bucket_words: int) -> np.ndarray:
    """HOT for the slots that hold over eight times the mean (at most an eighth
    of all, by that rule) and over 64 groups; HEAVY for those with more groups
    than a bucket has windows (and twice the mean, should all slots be so full)."""
    out = np.zeros(slots, np.uint8)
    hot, heavy = max(64, 8 * total // slots), max(64, bucket_words, 2 * total // slots)
    for r in counts.where(F.col("n") > min(hot, heavy)).select("slot", "n").toLocalIterator():
        out[r.slot] = (HOT if r.n > hot else 0) | (HEAVY if r.n > heavy else 0)
    return out


def slots_for(df: DataFrame, bucket_words: int) -> int:
    """Eight slots for each bucket that a table of this size (by the scan's own
    estimate, or a sum where there is none; some six bytes a word) will have, as
    a power of two."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return 1 << min(MOST_BITS, max(LEAST_BITS, (8 * size // (6 * bucket_words)).bit_length()))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_words: int = 500_000, bucket_words: int = 800_000, sketch_slots: int | None = None) -> DataFrame:
    """``id_col``, n_words, n_removed, kept_text of every row of ``df``.

    A word is removed if a window of ``window`` words that covers it occurs
    anywhere else, in the same or another document, as judged on the input.
    A chunk has some ``chunk_words`` words of documents and a bucket the
    super-k-mers of some ``bucket_words`` windows, so that the strings between
    them are few and large. ``sketch_slots`` (a power of two) is eight for
    each bucket, unless given.
    """
    if window < MER:
        raise ValueError(f"window must be {MER} words at least")
    parts = shuffle_partitions(df.sparkSession)
    docs = df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_order"), F.col(text_col).cast("binary").alias("_text"))
    slots = sketch_slots or slots_for(docs.select("_text"), bucket_words)
    counts, total = sketch_groups(docs, slots)
    marks = marked_groups(counts, total, slots, bucket_words)
    chunks, buckets = 1 + total // chunk_words, 1 + total // bucket_words
    dealt = docs.withColumn("_chunk", F.pmod(F.xxhash64("_order", "_text"), F.lit(chunks)).cast("int")).repartition(parts, "_chunk")
    packed = dealt.groupBy("_chunk").applyInArrow(_pack(window, marks, buckets), "bucket int, chunk int, blob binary")
    bits = packed.groupBy("bucket").applyInArrow(_count(window), "_chunk int, bucket int, bits binary")
    kind = df.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("_chunk").cogroup(bits.groupBy("_chunk")).applyInArrow(_cut_words(window, marks, buckets), f"_id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", id_col)
