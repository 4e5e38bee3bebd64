"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of all vote patterns in the corpus (at most
4^labellers rows, whatever the input) estimates how accurate each labeller is,
under independence given the class (Dawid and Skene 1979), without any truth.
Most labellers look for one fault and vote bad or nothing, since junk of one
kind is faultless in the other ways; abstention counts as a third answer.
The posterior of a text's pattern is its training label. A linear scorer over
hashed features (byte trigrams and bucketed statistics, whole texts) is fitted
to the posteriors of a bounded sample: the ``sample`` rows of each likely class
with the smallest hashes of their ids. Every row is scored with it, and the
posterior of its pattern weighs like EXTRA_TOKENS more tokens, so that a short
text goes by its faults and a long one by the scorer.

Statistics count tokens: words between white space, and in scripts that put no
blanks between words every character. Upper case, punctuation and letters are
Unicode's. A labeller can't tell, which weighs nothing, where some stray tokens
would change its vote, so it needs more evidence on a shorter text, without a
least length. ``function_words`` judges texts mostly in Latin letters, for the
languages it lists, and can't tell of others.

Defined results: null and blank texts get score 0 and are rejected. Texts on
which no labeller votes have the prior as training label and are not sampled.
If the corpus has no texts of one of the classes the scorer is constant: the
prior's side. Ids are only used to draw the sample. Repeated rows get equal
scores, null ids are scored like others, extra columns are kept or ignored
whatever their names, an empty table gives an empty table. A text is judged
whole in one task, in memory of some forty times its length.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, as_bytes, cut, map_batches, named, runs_by_size
from .substring_dedup import word_hashes

#: Frequent function words (fixed values) of ten languages in Latin letters.
FUNCTION_WORDS = (
    "the of and to in a is that it for was with as on be by this are from at an or not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la que el en y a los se del las un por con no una su para es al lo "
    "le et les des du une est que dans qui par pour au sur pas plus avec ce sont "
    "il di che è e per non della sono gli "
    "o os da em não uma com mais dos "
    "het een van dat niet op zijn voor "
    "w i się na nie z do jest "
    "och att det som på är av för "
    "ve bir bu için ile de"
).split()
#: (name, statistic, bad below, bad above, good from, good to); each abstains
#: between the limits.
LABELLERS = (
    ("shouting", "upper_share", None, 0.5, None, None),
    ("symbols", "symbol_share", None, 0.15, None, None),
    ("distinct", "distinct_share", 0.2, None, None, None),
    ("stutter", "repeat_share", None, 0.2, None, None),
    ("loops", "loop_share", None, 0.5, None, None),
    ("separators", "bare_share", None, 0.2, None, None),
    ("bangs", "bang_share", None, 0.2, None, None),
    ("function_words", "function_share", 0.02, None, 0.1, 0.6),
    ("punctuation", "stop_share", 0.005, 0.35, 0.06, 0.3),
)
#: The answer of a labeller that can't judge a text; it weighs nothing.
UNTOLD = 3
#: Tokens whose lack is no fault yet, and tokens that may be there by chance.
FEW_TOKENS, STRAY_TOKENS = 24, 2
#: Tokens that the posterior of a text's votes stands for in its score.
EXTRA_TOKENS = 8
STATISTICS = tuple(s for _, s, *_ in LABELLERS)
DIMS = 1 << 16
_LEVELS = 16

_SPACE, _UPPER, _LOWER, _SYMBOL, _BANG, _STOP, _ALNUM, _SOLO, _LATIN = (1 << i for i in range(9))
#: Scripts without blanks between words (fixed values): Thai and Lao, Myanmar,
#: Khmer, kana and ideographs.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_STOPS = frozenset(".!?,;:。，、！？；：،؟؛۔।॥።፣")
_BANGS = frozenset("!！")
_tables: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of every code point, made once for a process."""
    if not _tables:
        flags, low = np.zeros(sys.maxunicode + 1, np.uint16), np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Co", "Cs"):
                continue
            f = 0
            if ch.isspace():
                f |= _SPACE
            elif kind[0] in "LNM":
                f |= _ALNUM | (_UPPER if kind == "Lu" else _LOWER if kind == "Ll" else 0)
                f |= _LATIN if kind[0] == "L" and (cp < 0x250 or 0x1E00 <= cp < 0x1F00) else 0
                low[cp] = ord(ch.lower()[0])
            elif cp < 128 and ch not in ".,;:!?'\"()-" and cp > 32 or kind in ("Sm", "So", "Sk") and cp >= 128:
                f |= _SYMBOL
            flags[cp] = f | (_STOP if ch in _STOPS else 0) | (_BANG if ch in _BANGS else 0)
        for lo, hi in _UNSPACED:
            flags[lo : hi + 1] |= np.where(flags[lo : hi + 1] & _ALNUM, _SOLO, 0).astype(np.uint16)
        _tables.extend((flags, low))
    return _tables[0], _tables[1]


class Tokens:
    """Tokens of a run of texts by code points: token ``i`` is
    ``norm[start[i]:end[i]]`` (lower case), text ``t`` owns the tokens
    ``first[t]:first[t + 1]`` and the code points ``edge[t]:edge[t + 1]``."""

    def __init__(self, texts: list[bytes]):
        flags, low = _classes()
        known = [t.decode("utf-8", "replace") for t in texts]
        points = np.frombuffer(("\n".join(known) + "\n").encode("utf-32-le"), "<u4")
        self.edge = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in known), np.int64, len(known)))))
        self.flags = f = flags[points]
        self.norm = low[points]
        space = (f & _SPACE) > 0
        solo, alnum = (f & _SOLO) > 0, (f & _ALNUM) > 0
        begin = ~space
        begin[1:] &= space[:-1] | solo[1:] | solo[:-1] & alnum[1:]
        over = space.copy()  # a token ends before white space and before the next token
        over |= begin
        self.start = np.flatnonzero(begin)
        ends = np.flatnonzero(over)
        self.end = ends[np.searchsorted(ends, self.start, "right")] if len(self.start) else self.start
        self.first = np.searchsorted(self.start, self.edge)

    def __len__(self) -> int:
        return len(self.start)


def _function_hashes() -> np.ndarray:
    return np.unique(word_hashes(Tokens([" ".join(sorted(set(FUNCTION_WORDS))).encode()])))


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, one row of STATISTICS) of each text, whole texts; a
    function_share that can't be told is -1."""
    n_tokens, out = [], []
    known = _function_hashes()
    for lo, hi in runs_by_size(texts, 1 << 19):
        tk = Tokens(texts[lo:hi])
        n = np.diff(tk.first)
        tokens = np.maximum(n, 1)

        def per_token(flag, first=tk.first):
            c = np.concatenate(([0], np.cumsum(flag)))
            return (c[first[1:]] - c[first[:-1]]).astype(float)

        def per_point(bit, f=tk.flags, edge=tk.edge):
            return np.add.reduceat((f & bit) > 0, edge[:-1], dtype=np.int64).astype(float)

        upper, lower = per_point(_UPPER), per_point(_LOWER)
        size = np.maximum(np.diff(tk.edge) - per_point(_SPACE), 1)
        alnum = np.concatenate(([0], np.cumsum((tk.flags & _ALNUM) > 0)))
        bare = alnum[tk.end] == alnum[tk.start]
        last = tk.flags[tk.end - 1]
        h = word_hashes(tk)
        text_of = np.repeat(np.arange(len(n)), n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
        distinct = _distinct(text_of, h, len(n))
        pair = h.copy()
        pair[:-1] = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        inner = np.ones(len(h), bool)
        inner[tk.first[1:][n > 0] - 1] = False
        loops = 1 - _distinct(text_of[inner], pair[inner], len(n)) / np.maximum(per_token(inner), 1)
        loops[n < 2] = 0.0
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        cols = {
            "upper_share": upper / np.maximum(upper + lower, 1),
            "symbol_share": per_point(_SYMBOL) / size,
            # long texts repeat words by nature: compare to the square root rule
            "distinct_share": np.minimum(distinct / np.minimum(tokens, 4 * np.sqrt(tokens)), 1.0),
            "repeat_share": per_token(same) / tokens,
            "loop_share": loops,
            "bare_share": per_token(bare) / tokens,
            "bang_share": per_token((last & _BANG) > 0) / tokens,
            "function_share": np.where(2 * per_point(_LATIN) >= per_point(_ALNUM), per_token(known[at] == h) / tokens, -1.0),
            "stop_share": per_token((last & _STOP) > 0) / tokens,
        }
        n_tokens.append(n)
        out.append(np.stack([cols[s] for s in STATISTICS], axis=1))
    if not out:
        return np.zeros(0, np.int64), np.zeros((0, len(STATISTICS)))
    return np.concatenate(n_tokens), np.concatenate(out)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def _vote(x: np.ndarray, limits: tuple, one) -> np.ndarray:
    below, above, lo, hi = limits
    out = np.zeros(len(x), np.int8)
    if lo is not None:
        out[(x - STRAY_TOKENS * one >= lo) & (x <= hi)] = 2
    if below is not None:
        out[x < below * (1 - FEW_TOKENS * one)] = 1
    if above is not None:
        out[x - STRAY_TOKENS * one > above] = 1
    return out


def votes(n_tokens: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """1 for bad, 2 for good, 0 for neither and UNTOLD of each labeller on each
    text. It can't tell where some stray tokens would change its vote."""
    out = np.full(stats.shape, UNTOLD, np.int8)
    for j, (_, _, *limits) in enumerate(LABELLERS):
        x = stats[:, j]
        vote, sure = _vote(x, limits, 0.0), _vote(x, limits, 1 / np.maximum(n_tokens, 1))
        told = (vote == sure) & (x >= 0) & (n_tokens > 0)
        out[told, j] = vote[told]
    return out


_BASE = 4 ** np.arange(len(LABELLERS))


def log_odds(patterns: np.ndarray, prior: float, answers: np.ndarray) -> np.ndarray:
    """Log odds of good for vote patterns; without a vote those of the prior."""
    odds = np.full(len(patterns), np.log(prior / (1 - prior)))
    voting = ((patterns == 1) | (patterns == 2)).any(axis=1)
    for j in range(patterns.shape[1]):
        at = np.flatnonzero(voting & (patterns[:, j] != UNTOLD))
        v = patterns[at, j]
        odds[at] += np.log(answers[j, 1, v] / answers[j, 0, v])
    return np.clip(odds, -30, 30)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """(prior of good, answers[labeller, class, vote], posterior of good of each
    pattern). Starts from the majority of the votes; stops when it settles."""
    good, bad = (patterns == 2).sum(axis=1), (patterns == 1).sum(axis=1)
    post = (good + 0.5) / (good + 2 * bad + 1.0)
    w = counts.astype(float)
    prior, n = 0.5, patterns.shape[1]
    answers = np.full((n, 2, 3), 1 / 3)
    for _ in range(rounds):
        prior = float(np.clip((w * post).sum() / max(w.sum(), 1), 0.01, 0.99))
        for j in range(n):
            for c, p in ((0, w * (1 - post)), (1, w * post)):
                seen = np.array([p[patterns[:, j] == v].sum() for v in range(3)]) + 0.1
                answers[j, c] = seen / seen.sum()
        new = 1 / (1 + np.exp(-log_odds(patterns, prior, answers)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return prior, answers, post


def features(text: bytes, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: (slots, weights), trigrams by their share."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    tail = (np.uint32(0x9E37) * (np.arange(len(stats), dtype=np.uint32) * np.uint32(_LEVELS) + np.clip(stats * _LEVELS, 0, _LEVELS - 1).astype(np.uint32) + np.uint32(1))) % np.uint32(DIMS)
    if len(b) < 3:
        return tail, np.full(len(tail), 0.5)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    n = np.bincount(slot, minlength=DIMS)
    at = np.flatnonzero(n)
    return np.concatenate((at, tail)), np.concatenate((8.0 * n[at] / len(slot), np.full(len(tail), 0.5)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, passes: int = 12, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad steps in a fixed order."""
    w, b, seen = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-4)
    order = np.random.default_rng(0)
    bias_seen = 1e-4
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - target[i]
            step = g * x + decay * w[at]
            np.add.at(seen, at, step * step)
            np.subtract.at(w, at, rate * step / np.sqrt(seen[at]))
            bias_seen += g * g
            b -= rate * g / np.sqrt(bias_seen)
    return w, float(b)


class Model:
    """The fitted scorer: weights by slot, and what EM found about labellers."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float, answers: np.ndarray):
        self.weights, self.bias, self.prior, self.answers = weights, bias, prior, answers

    def scores(self, texts: list[bytes]) -> np.ndarray:
        n, stats = statistics(texts)
        told = log_odds(votes(n, stats), self.prior, self.answers)
        out = np.zeros(len(texts))
        w = self.weights.astype(np.float32)
        for i, t in enumerate(texts):
            if not n[i]:
                continue
            b = np.frombuffer(t, np.uint8).astype(np.uint32)
            z = self.bias + 0.5 * float(self.weights[features(b"", stats[i])[0]].sum())
            if len(b) >= 3:
                code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
                z += 8.0 * float(w[(code * np.uint32(0x9E3779B1)) >> np.uint32(16)].mean(dtype=np.float64))
            z = (n[i] * z + EXTRA_TOKENS * told[i]) / (n[i] + EXTRA_TOKENS)
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> Model:
    """EM over the votes on all rows; the scorer on at most 2 * ``sample`` rows."""
    docs = df.select(F.col(id_col).cast("string").alias("_key"), F.col(text_col).cast("binary").alias("_text"))

    def vote(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(b.column(1))
        p = votes(*statistics(texts)) @ _BASE
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p.astype(np.int32))], ["_key", "pattern"])

    voted = cut(map_batches(docs, vote, "_key string, pattern int", SLICE), "votes")  # texts are judged once
    ranked = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 4^labellers rows at most
    codes = np.array(sorted(r.pattern for r in ranked), np.int64)
    count_of = {r.pattern: r.n for r in ranked}
    patterns = codes[:, None] // _BASE[None, :] % 4 if len(codes) else np.zeros((0, len(LABELLERS)), np.int64)
    voting = ((patterns == 1) | (patterns == 2)).any(axis=1)
    prior, acc, post = expectation_maximisation(patterns[voting], np.array([count_of[c] for c in codes[voting].tolist()]))
    likely = {int(c): float(p) for c, p in zip(codes[voting], post)}

    def draw(b: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = as_bytes(b.column(0))
        n, stats = statistics(texts)
        p = [likely.get(int(c), 0.5) for c in votes(n, stats) @ _BASE]
        rows = [features(t, s) for t, s in zip(texts, stats)]  # packed, as the driver holds the sample's
        at, x = ([r[0].astype("<u2").tobytes() for r in rows], [r[1].astype("<f4").tobytes() for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["p", "at", "x"])

    chosen = None
    for lo, hi in ((0.0, 0.5), (0.5, 1.0)):
        some = [c for c, p in likely.items() if (p < 0.5) == (hi == 0.5)]
        keys = voted.where(F.col("pattern").isin(some)).select("_key").where("_key is not null").distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample)
        chosen = keys if chosen is None else chosen.unionAll(keys)
    # ids of the sample only: its size is the documented bound
    few = docs.join(F.broadcast(chosen.distinct()), "_key", "left_semi").select("_text").dropDuplicates()
    got = sorted((r.p, bytes(r.at), bytes(r.x)) for r in map_batches(few, draw, "p double, at binary, x binary", SLICE).toLocalIterator())
    target = np.array([p for p, _, _ in got])
    if not got or (target < 0.5).all() or (target >= 0.5).all():
        sign = prior if not got else float(target.mean())
        return Model(np.zeros(DIMS), 2.0 if sign >= 0.5 else -2.0, prior, acc)
    w, b = fit([(np.frombuffer(a, "<u2"), np.frombuffer(x, "<f4")) for _, a, x in got], target)
    return Model(w, b, prior, acc)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "_quality") -> DataFrame:
    """The columns of ``df`` and ``score_col``, from the whole text."""
    # by position, so that no name of a column matters
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named(*df.columns))])
    at = [i for i, (c, kind) in enumerate(df.dtypes) if c == text_col and kind == "string"]
    # a string is read from its row, so that texts are sent once
    packed = df.select(row.alias("_row"), *([] if at else [named(text_col)[0].cast("binary").alias("_text")]))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(b.column(0).field(at[0]) if at else b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(texts))], ["_row", "_quality"])

    out = map_batches(packed, fn, f"_row {packed.schema['_row'].dataType.simpleString()}, _quality double", SLICE)
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(df.columns)], F.col("_quality").alias(score_col))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = 3000) -> DataFrame:
    """``id_col``, quality (0 to 1), keep of every row of ``df``."""
    model = train(df, id_col, text_col, sample)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = score(docs, model, "_text")
    return out.select(F.col("_id").alias(id_col), F.col("_quality").alias("quality"), (F.col("_quality") >= threshold).alias("keep"))
