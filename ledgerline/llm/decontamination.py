"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item within k edits holds at least one of any k + 1
pieces of the item unchanged. Items are split into k + 1 pieces; one automaton
finds all exact piece hits of all items in a pass over a text; each hit names
the place where the item would lie, and Myers' bit-parallel algorithm verifies
the distance there: first of the two pieces around the hit with one edit, then
of ever larger runs of j pieces with j - 1 edits (one of two neighbouring runs
must keep to that), so that few chance hits reach the whole item. The edits of a
run are at least those of its blocks; a block is verified once at a place, for
all items that share it, and the places of an item that are left are merged
before the whole of it is verified. Every occurrence
within the budget is found.

The budget of an item is ``error_rate`` of its length, whatever the length of
the pieces (about 9 characters at a tenth); ``piece_chars`` above 1 is a guard
that lowers the budget to leave pieces of so many characters. Texts and items are compared in lower
case with white space collapsed. An item too short for one edit (under 10
characters at a tenth) counts only as whole words: "the cat" isn't in "bathe
catalog". Letters without case, as in Chinese or Arabic, bound no words.

The items are broadcast in parts of at most ``part_bytes``, each read by the
driver for itself; more items mean more passes, not a larger broadcast, and one
join of the texts with what the passes found. With one part texts never move.

Defined results: null and empty texts, and null or blank items, match nothing.
Equal items match together, each under its own id; an item with a null id
counts as contamination but adds no id. Null doc ids and repeated rows are
judged like others, extra columns are kept or ignored whatever their names,
empty tables give empty or clean results. A text is searched whole in one task,
in memory of a few times its length; the time grows with its length.
"""

from __future__ import annotations

import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, slices, then_released


#: Verified blocks that are remembered in a text.
MEMORY = 1 << 20


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, error_rate: float, piece_chars: int) -> int:
    return max(0, min(int(length * error_rate), length // piece_chars - 1))


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def ladders(n: int) -> list[list[tuple[int, list[tuple[int, int]]]]]:
    """For each of ``n`` pieces, from the two or three around it up to all: the
    most edits of a run of pieces, and what the run adds as blocks [a, b) of one
    or two pieces. The runs are the nodes of one binary tree over the pieces."""
    out: list[list] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        mid = (a + b) // 2
        for own, other in (((a, mid), (mid, b)), ((mid, b), (a, mid))):
            step = (b - a - 1, [(x, min(x + 2, other[1])) for x in range(other[0], other[1], 2)])
            for i in range(*own):
                out[i].append(step)
            todo.append(own)
    return [steps[::-1] for steps in out]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to a pattern of
    length ``m`` (Myers 1999, on Python's integers); the first end on ties."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no carry into the first row
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _apart(a: str, b: str) -> bool:
    """May a word end between two neighbouring characters?"""
    return not (a.isalnum() and b.isalnum()) or unicodedata.category(a) == "Lo" or unicodedata.category(b) == "Lo"


class Matcher:
    """All items of a part, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, piece_chars: int):
        by_text: dict[str, list] = {}
        for i, t in items:
            if t := normalise(t):
                by_text.setdefault(t, []).append(i)
        self.items = [(t, ids, budget(len(t), error_rate, piece_chars)) for t, ids in sorted(by_text.items())]
        self.short = [len(t) * error_rate < 1 for t, _, _ in self.items]
        self.blocks: list[tuple[str, dict[str, int]]] = []  # shared by all items
        known: dict[str, int] = {}
        # piece -> (nearest block, its place from the piece, edits) -> [(item, place of the piece, further steps)]
        where: dict[str, dict[tuple[int, int, int] | None, list]] = {}
        for n, (t, _, k) in enumerate(self.items):
            pieces = pieces_of(t, k)
            ends = [off for off, _ in pieces] + [len(t)]
            steps: dict[int, tuple] = {}
            for (off, piece), ladder in zip(pieces, ladders(k + 1)):
                own = []
                for step in ladder:
                    if id(step) not in steps:
                        at = []
                        for a, b in step[1]:
                            block = t[ends[a] : ends[b]]
                            if block not in known:
                                known[block] = len(self.blocks)
                                self.blocks.append((block, pattern_masks(block)))
                            at.append((known[block], ends[a]))
                        steps[id(step)] = (step, step[0], at)
                    own.append(steps[id(step)][1:])
                first = (own[0][1][0][0], own[0][1][0][1] - off, own[0][0]) if own else None
                where.setdefault(piece, {}).setdefault(first, []).append((n, off, own))
        self.masks = [pattern_masks(t) for t, _, _ in self.items]
        self.automaton = ahocorasick.Automaton()
        for piece, groups in where.items():
            self.automaton.add_word(piece, (len(piece), list(groups.items())))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def _whole(self, n: int, text: str, start: int) -> bool:
        """Does the item stand at ``start``, unchanged?"""
        item = self.items[n][0]
        if start < 0 or not text.startswith(item, start):
            return False
        end = start + len(item)
        return not self.short[n] or (start == 0 or _apart(text[start - 1], item[0])) and (end == len(text) or _apart(item[-1], text[end]))

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of each item that occurs, at its best;
        of equally good places the first."""
        if self.empty or not text:
            return []
        found: dict[int, tuple[int, int]] = {}
        places: dict[int, set[int]] = {}
        seen: dict[tuple[int, int, int], int] = {}

        def edits(block: int, at: int, most: int) -> int:
            """The least edits of a block within ``most`` characters of a place."""
            d = seen.get((block, at, most))
            if d is None:
                part, masks = self.blocks[block]
                d = 0 if at >= 0 and text.startswith(part, at) else best_match(masks, len(part), text[max(0, at - most) : max(0, at + len(part) + most)])[0]
                if len(seen) >= MEMORY:
                    seen.clear()
                seen[block, at, most] = d
            return d

        def may_be(steps: list, start: int) -> bool:
            total = 0
            for most, blocks in steps:
                for block, to in blocks:
                    total += edits(block, start + to, most)
                    if total > most:
                        return False
            return True

        for end, (size, groups) in self.automaton.iter(text):
            at = end + 1 - size
            for first, members in groups:
                if first is not None and edits(first[0], at + first[1], first[2]) > first[2]:
                    continue
                for n, off, steps in members:
                    start = at - off
                    if n in found or start in places.get(n, ()):
                        continue
                    if self._whole(n, text, start):
                        found[n] = (0, start + len(self.items[n][0]))
                    elif steps and may_be(steps, start):
                        places.setdefault(n, set()).add(start)
        for n, starts in places.items():
            item, _, k = self.items[n]
            if n in found:
                continue
            spans: list[list[int]] = []
            for start in sorted(starts):
                lo, hi = max(0, start - k), start + len(item) + k
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                d, e = best_match(self.masks[n], len(item), text[lo:hi])
                if d <= k and d < found.get(n, (k + 1,))[0]:
                    found[n] = (d, lo + e)
        return [(n, d, e) for n, (d, e) in sorted(found.items())]


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int):
    """The number of parts, and a function that reads one: items whose texts
    are ``part_bytes`` at most (or one longer item)."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes))  # twice as many, as a hash isn't even

    def read(p: int) -> list:
        return [(r.i, r.t) for r in (items if parts == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p)).toLocalIterator()]

    return parts, read


def find_items(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.1, piece_chars: int = 1, part_bytes: int = 16 << 20, hits_col: str = "_hits") -> DataFrame:
    """The columns of ``df``, and ``hits_col``: array<struct<item_id, distance,
    end>> with an entry for each item that occurs in the text (its nearest place)."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    hits = f"array<struct<item_id:{kind},distance:int,end:int>>"
    parts, read = _parts(benchmark, item_id, item_text, part_bytes)
    context = df.sparkSession.sparkContext
    (text,) = named(text_col)
    # by position, so that no name of a column matters
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named(*df.columns))])
    back = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(df.columns)]
    if parts == 1:
        found = _search(df.select(row.alias("_row"), text.alias("_text")), context.broadcast(read(0)), hits, error_rate, piece_chars)
        return found.select(*back, F.col("_new").alias(hits_col))
    texts = df.select(F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("_row"), text.alias("_text"))
    found = None
    for p in range(parts):
        items = context.broadcast(read(p))  # kept on disk; the driver holds one part at a time
        some = cut(_search(texts.where("_text is not null"), items, hits, error_rate, piece_chars).where(F.size("_new") > 0).distinct(), "hits")
        items.destroy()
        found = some if found is None else found.unionAll(some)
    each = found.groupBy("_row").agg(F.flatten(F.collect_list("_new")).alias("_new")).select(F.col("_row").alias("_of"), "_new")
    out = df.select(row.alias("_row"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("_key")).join(cut(each, "hits"), F.col("_key") == F.col("_of"), "left")
    return out.select(*back, F.coalesce("_new", F.expr(f"cast(array() as {hits})")).alias(hits_col))


def _search(packed: DataFrame, part, hits: str, error_rate: float, piece_chars: int) -> DataFrame:
    """_row, and _new: what a part of the items (a broadcast) has in _text."""
    row = packed.schema["_row"].dataType.simpleString()
    kind = packed.sparkSession.range(0).select(F.expr(f"cast(null as {hits})").alias("x")).schema

    def fn(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        matcher = Matcher(part.value, error_rate, piece_chars)
        want = to_arrow_schema(kind).field(0).type
        for b in slices(batches):
            got = [[{"item_id": i, "distance": d, "end": e} for n, d, e in matcher.find(normalise(t)) for i in matcher.items[n][1]] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, want)], ["_row", "_new"])

    return packed.mapInArrow(then_released(fn), f"_row {row}, _new {hits}")


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``id_col``, contaminated, item_ids (sorted), distance (the least, or null)
    of every row of ``df``."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = find_items(docs, benchmark, "_text", **kw)
    ids = F.array_sort(F.array_distinct(F.filter("_hits.item_id", lambda x: x.isNotNull())))
    return out.select(F.col("_id").alias(id_col), (F.size("_hits") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min("_hits.distance").alias("distance"))
