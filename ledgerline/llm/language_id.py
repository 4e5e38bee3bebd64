"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three
characters, words bounded by a mark) in order of frequency. A document's own
profile is compared to that of every language by the out-of-place distance: the
sum, over the document's n-grams, of how far each is from its place in the
language's profile, with the profile's length for n-grams that it lacks (Cavnar
and Trenkle, "N-gram-based text categorization", 1994).

Profiles are learned from labelled rows: at most ``sample_per_language`` rows
of each language, those with the smallest hashes of their ids (a documented,
bounded sample; whole texts of those rows). N-grams are counted in parallel and
only ``profile_size`` for each language reach the driver.

An n-gram is a number of 63 bits: three places for code points in lower case, an
absent one 0 and the mark 2^21 - 1. No two n-grams share a number.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Ties between languages go to the first in name order; ties between n-grams to
the smaller code. The score is 1 minus the winner's distance as a share of the
largest possible distance. With no labelled rows every text is ``und``. Null
ids and repeated rows are predicted like others, extra columns are ignored
whatever their names, an empty table gives an empty table. A text is counted
whole in one task, in memory of some hundred times its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, then_released
from .pieces import text_runs

UNKNOWN = "und"
#: Labels that aren't a small set are an error, not a larger broadcast.
MAX_LANGUAGES = 10_000
_LIMIT = 1 << 16
#: The mark at the bounds of words: no code point.
MARK = (1 << 21) - 1
_symbols: np.ndarray | None = None


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: MARK for what isn't a letter, else the code
    point of its lower case."""
    global _symbols
    if _symbols is None:
        import sys

        t = np.full(sys.maxunicode + 1, MARK, np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                t[cp] = ord(ch.lower()[0])
        _symbols = t
    return _symbols


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of every n-gram of 1 to 3 symbols of the texts."""
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(joined)]
    s = np.concatenate(([MARK], _symbol_table()[joined], [MARK])).astype(np.int64)
    owner = np.concatenate(([0], owner, owner[-1:] if len(owner) else [0]))
    keep = np.concatenate(([True], (s[1:] != MARK) | (s[:-1] != MARK)))  # one mark for each gap
    s, owner = s[keep], owner[keep]
    letter = s != MARK
    two = letter[1:] | letter[:-1]
    three = letter[1:-1]
    first = np.where(letter[:-1], owner[:-1], owner[1:])
    out_o = np.concatenate((owner[letter], first[two], owner[1:-1][three]))
    out_c = np.concatenate((s[letter], (s[:-1] << 21 | s[1:])[two], (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[three]))
    return out_o, out_c


def ranked(texts: list[str], size: int) -> list[np.ndarray]:
    """The codes of each text's most frequent n-grams, the first ``size``."""
    owner, code = grams(texts)
    if not len(code):
        return [np.empty(0, np.int64)] * len(texts)
    known, place = np.unique(code, return_inverse=True)
    key = np.sort(owner * len(known) + place)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    owner, place = np.divmod(key[new], len(known))
    order = np.lexsort((place, -count, owner))
    code = known[place[order]]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [code[a : min(b, a + size)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def learn(labelled: DataFrame, size: int = 400, sample_per_language: int = 2000) -> dict[str, np.ndarray]:
    """Profiles from rows of (_key, _text, _lang), each language's n-grams in
    order of frequency. Of a language, at most ``sample_per_language`` rows."""
    rows = labelled.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull()).withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_key"), 33))
    # a share of the hashes that holds the sample, so that other texts don't move
    share = F.least(F.lit(1.0), F.lit(1.25 * sample_per_language + 50) / F.count("*"))
    cutoffs = [(r[0], r[1]) for r in rows.groupBy("_lang").agg((share * (1 << 31)).alias("_cutoff")).limit(MAX_LANGUAGES + 1).collect()]
    if len(cutoffs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    limits = labelled.sparkSession.createDataFrame(cutoffs, "_lang string, _cutoff double")
    near = rows.join(F.broadcast(limits), "_lang").where("_hash < _cutoff").select("_lang", "_hash", "_key", "_text")
    w = Window.partitionBy("_lang").orderBy("_hash", "_key", "_text")
    few = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample_per_language)

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts) if x == lang]
                for lo, hi in text_runs(own, _LIMIT):
                    code, n = np.unique(grams(own[lo:hi])[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counts = few.select("_lang", "_text").mapInArrow(then_released(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code")))
    top = counts.withColumn("place", place).where(F.col("place") <= size).collect()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    """Places of the n-grams of all languages in one sorted table."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.names])) if self.names else np.zeros(0, np.int64)
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)  # last: in no profile
        for j, k in enumerate(self.names):
            self.places[np.searchsorted(self.codes, profiles[k]), j] = np.arange(len(profiles[k]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for own in ranked(texts, self.size):
            if not len(own) or not self.names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            at = np.where(self.codes[at] == own, at, len(self.codes))
            place = self.places[at]
            away = np.abs(place - np.arange(len(own))[:, None])
            distance = np.where(place < 0, self.size, np.minimum(away, self.size)).sum(axis=0)
            best = int(np.argmin(distance))
            langs.append(self.names[best])
            scores.append(1.0 - float(distance[best]) / (self.size * len(own)))
        return langs, scores


def predict(df: DataFrame, profiles: dict[str, np.ndarray], size: int = 400, text_col: str = "text", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score added to the columns of ``df`` (replacing columns of
    those names, and without the columns ``leave_out``)."""
    model = Profiles(profiles, size)
    rest = [c for c in df.columns if c not in ("lang_pred", "score", *leave_out)]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in b.column(1).to_pylist()]
        langs, scores = [], []
        for lo, hi in text_runs(texts, _LIMIT):
            x, y = model.predict(texts[lo:hi])
            langs += x
            scores += y
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_row", "lang_pred", "score"])

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(text_col).alias("_text"))
    out = map_batches(packed, fn, f"_row {packed.schema['_row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("_row.*", "lang_pred", "score")


def language_id(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, sample_per_language: int = 2000) -> DataFrame:
    """``id_col``, held_out, lang_pred, score of every row; profiles are learned
    from the rows where ``held_out`` (a Column) is not true."""
    rows = df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = learn(rows.where(~F.col("held_out")), size, sample_per_language)
    return predict(rows.select("_key", "held_out", "_text"), profiles, size, "_text", ("_text",)).select(F.col("_key").alias(id_col), "held_out", "lang_pred", "score")
