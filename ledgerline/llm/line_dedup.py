"""Line de-duplication by a tree of line templates; DataFrame functions only.

Lines are parsed to templates by a tree of fixed depth, in the manner of log
parsers: the first level is the number of tokens, the next levels are the
leading tokens, tokens with a digit count as ``<*>``. Below a leaf the other
positions are generalised too: a position holds its token if one token makes up
at least ``constant`` of the leaf's lines, else ``<*>``.

Two kinds of template recur:

* one masked line (only digits vary) in at least ``min_docs`` documents;
* the generalised template of a leaf, met by ``min_generalised`` documents with
  at least ``similarity`` of the positions after the leading tokens constant
  and equal.

A leaf may hold several templates, however many other lines it has: the lines
that share a token at a position are a group like the leaf, and each different
group is generalised by itself. Shares are of pairs of a line and a document;
what ``min_docs`` and ``min_generalised`` count are distinct documents. A line in
several templates goes with the one that comes first.

A recurring template stays where it comes first (the smallest document key)
and its lines are dropped from all other documents; within a document nothing
is dropped. Blank lines, and lines under ``min_tokens`` tokens (none by default),
are no templates and stay.

Scale: lines are parsed once and only 128-bit hashes and document keys of them
move. Line texts move for leaves with several different lines in enough
documents, each distinct line once for a task, from the documents that hold one
first; beyond some LEAF_SLOTS such leaves the broadcasts no longer hold texts and
lines back: all are parsed again and the distinct lines of every leaf move.
Where the template of a whole leaf takes a line, the groups of only such lines
are left out. The tokens of a group are counted where its lines meet, and dealt
out beyond GROUP_TOKENS. Texts move once, to meet the lines that go. What a join needs of a leaf, a
group or a line is written first, so that Spark may split the other side where
one of them is hot.

Defined results: null text stays null, empty text stays empty, and a text whose
lines all go becomes empty. Rows with the same id and text are one document.
Null ids come first in the order of documents. Ties between tokens go to the
smaller token. Extra columns are kept, whatever their names. Lines end at \\n
only. An empty table gives an empty table. A text is split in one task, whose
memory holds a few copies of it; a line of n tokens is in n groups at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named


def _masked(line: Column) -> Column:
    """A line as its tokens behind single blanks, those with an ASCII digit as
    ``<*>``. Lines without digits and odd blanks, which are most, are left."""
    plain = F.trim(F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " "))
    odd = line.contains("  ") | line.rlike("[0-9\\t\\x0B\\f\\r]")
    return F.when(odd, F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(F.trim(line))


def _tokens(m: Column) -> Column:
    return F.when(m == "", 0).otherwise(1 + F.octet_length(m) - F.octet_length(F.replace(m, F.lit(" "), F.lit(""))))


def _hashed(lines: DataFrame, min_tokens: int, depth: int) -> DataFrame:
    """The lines x (m: masked, n: tokens) that count, as columns, with h1 and h2
    (the line's hash), leaf1 and leaf2 (the hash of its path in the tree). A
    line is masked in the array that is exploded, so it is masked once."""
    path = F.substring_index("m", " ", depth)
    own = lines.where(F.col("x.n") >= min_tokens).select(*[c for c in lines.columns if c != "x"], "x.m", "x.n")
    return own.withColumns({"h1": F.xxhash64("m"), "h2": F.xxhash64(F.lit(1), "m"), "leaf1": F.xxhash64("n", path), "leaf2": F.xxhash64(F.lit(1), "n", path)})


def _promising(rows: DataFrame, tail: Column, similarity: float) -> DataFrame:
    """``rows`` without the small leaves in which no template can matter. Two
    lines that meet one template share its tokens where both meet it, which is
    at 2 * similarity - 1 of the positions at least; a template met by one line
    alone says no more than the line. Chance meetings under a path end here."""
    share = F.lit(max(0.0, 2 * similarity - 1))
    alike = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) >= share * F.size(a)
    small = rows.where(F.col("kinds") <= FEW_LINES)
    met = small.groupBy("leaf1", "leaf2").agg(F.collect_list(tail).alias("t"))  # FEW_LINES at most
    pair = F.transform("t", lambda a, i: F.exists(F.slice("t", i + 2, FEW_LINES), lambda b: alike(a, b)))
    kept = cut(met.where(F.exists(pair, lambda e: e)).select("leaf1", "leaf2"), "promising")
    return rows.where(F.col("kinds") > FEW_LINES).unionByName(small.join(kept, ["leaf1", "leaf2"], "left_semi"))


def _groups(rows: DataFrame, settled: DataFrame, tail: Column, depth: int, least: int, constant: float, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(leaf1, leaf2, h1, h2, pairs, kinds, grp: the lines of groups; those of them for
    which a group is kept). The lines of a leaf that share a token at a position
    are a group, with its pairs of line and document, if a line that isn't
    ``settled`` may meet its template; all others only repeat what is known. Groups of the same lines are one: they are known
    by the sums of the lines' hashes.

    A line that meets a template with another line shares its tokens at
    2 * similarity - 1 of the positions. Its tokens at ``similarity`` of them must
    each make up ``constant`` of the group's pairs, and a token has no more pairs
    in a group than in its leaf, so a line meets none in groups beyond a size."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    at, line = ["leaf1", "leaf2", "pos", "token"], ["h1", "h2"]
    left = cut(rows.join(settled, line, "left_anti").drop("pairs", "kinds"), "unsettled")
    rows = rows.join(left.select("leaf1", "leaf2").distinct(), ["leaf1", "leaf2"], "left_semi")
    spread = lambda r: r.select("leaf1", "leaf2", "h1", "h2", "docs", F.posexplode(tail).alias("pos", "token"))
    asked = cut(spread(left).select(*at).distinct(), "asked")
    near = cut(spread(rows).join(asked, at, "left_semi"), "spread")
    shared = near.groupBy(*at).agg(F.sum("docs").alias("pairs"), F.count("*").alias("kinds"), wide("h1").alias("s1"), wide("h2").alias("s2"))
    shared = cut(shared.where("kinds > 1").select(*at, "pairs", "kinds", F.xxhash64("s1", "s2", "kinds").alias("grp")), "shared")
    held = cut(near.join(shared, at).select("leaf1", "leaf2", *line, "pairs", "kinds", "grp"), "held")
    places = held.groupBy(*line).agg(F.collect_list("pairs").alias("w"))  # a line's positions at most
    t, s = F.col("n") - depth, F.size("w")
    weights = F.sort_array(F.concat("w", F.array_repeat("docs", t - s)), asc=False)
    most = F.element_at(weights, F.greatest(F.lit(1), F.ceil(similarity * t)).cast("int")) / F.lit(constant)
    open_ = cut(left.join(places, line).where(s >= max(0.0, 2 * similarity - 1) * t).select(*line, most.alias("most")), "open")
    able = cut(held.where(F.col("pairs") >= least).join(open_, line).where(F.col("pairs") <= F.col("most")).select(*line, "leaf1", "leaf2", "grp", "pairs").distinct(), "able")
    held = cut(held.distinct().join(able.select("leaf1", "leaf2", "grp").distinct(), ["leaf1", "leaf2", "grp"], "left_semi"), "members")
    return held, able


def _in_groups(rows: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """The lines of some groups, as _templates() takes them."""
    own = held.join(groups, ["leaf1", "leaf2", "grp"], "left_semi")
    return rows.drop("pairs", "kinds").join(own, ["leaf1", "leaf2", "h1", "h2"])


def _in_doubt(held: DataFrame, able: DataFrame, rows: DataFrame, settled: DataFrame, known: DataFrame, done: DataFrame, least: int) -> DataFrame:
    """The groups that aren't ``done`` and may still give a line a place before
    the one it is ``known`` to go with: those whose earliest line comes before it.
    Lines that can't meet a group's template don't count, and it takes several
    in enough documents."""
    group, line = ["leaf1", "leaf2", "grp"], ["h1", "h2"]
    rest = held.join(done, group, "left_anti").select(*group, *line)
    may = rest.join(settled, line, "left_semi").unionByName(rest.join(able, [*group, *line], "left_semi"))
    may = may.join(rows.select(*line, "first", "docs"), line).join(known, line, "left")
    judged = may.groupBy(*group).agg(F.min("first").alias("early"), F.max("lead").alias("late"), F.count_if(F.col("lead").isNull()).alias("unknown"), F.count("*").alias("kinds"), F.sum("docs").alias("pairs"))
    judged = judged.where((F.col("kinds") > 1) & (F.col("pairs") >= least))
    return judged.where((F.col("unknown") > 0) | (F.col("late") > F.col("early"))).select(*group)


#: Lines of a leaf that are compared with each other before their tokens are dealt.
FEW_LINES = 16
#: Slots of the broadcasts that keep most texts and lines out of the search for
#: variants; their size is fixed, and what passes wrongly meets the exact join.
LEAF_SLOTS = 1 << 18
#: Tokens of a group whose lines meet in one row; a larger group's are dealt out.
GROUP_TOKENS = 1 << 16


def _forms(rows: DataFrame, tail: Column, depth: int, constant: float, similarity: float) -> DataFrame:
    """leaf1, leaf2, grp, form: the generalised template of every group that has
    enough constant positions for a line to meet it, null where one isn't."""
    group, t = ["leaf1", "leaf2", "grp"], F.col("n") - depth
    size = F.col("kinds") * t
    # no line can meet a template with fewer constant positions
    enough = lambda f: F.size(F.filter(f, lambda x: x.isNotNull())) >= F.greatest(F.lit(1), similarity * t)
    few = rows.where(size <= GROUP_TOKENS).groupBy(*group, "n", "pairs").agg(F.collect_list(F.struct("m", "docs")).alias("_of"))
    lines = F.transform("_of", lambda x: F.struct(F.slice(F.split(x["m"], " "), F.lit(depth + 1), t).alias("t"), x["docs"].alias("docs")))
    zero = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("string").alias("best"), F.lit(0).cast("long").alias("most"))

    def met(a: Column, x: Column) -> Column:  # tokens come in order, so the smaller of a tie stays
        hits = F.when(a["token"] == x["token"], a["hits"] + x["docs"]).otherwise(x["docs"])
        return F.struct(x["token"].alias("token"), hits.alias("hits"), F.when(hits > a["most"], x["token"]).otherwise(a["best"]).alias("best"), F.greatest(hits, a["most"]).alias("most"))

    own = lambda o, i: F.array_sort(F.transform(o, lambda x: F.struct(F.get(x["t"], i).alias("token"), x["docs"].alias("docs"))))
    best = lambda o, i: F.aggregate(own(o, i), zero, met, lambda a: F.when(a["most"] >= constant * F.col("pairs"), a["best"]))
    form = lambda o: F.transform(F.sequence(F.lit(0), t - 1), lambda i: best(o, i))
    # arrays of one, so that lines are split once and a form is found once
    few = few.select(*group, F.explode(F.filter(F.transform(F.array(lines), form), enough)).alias("form"))

    tokens = rows.where(size > GROUP_TOKENS).select(*group, "n", "pairs", "docs", F.posexplode(tail).alias("pos", "token")).groupBy(*group, "n", "pairs", "pos", "token").agg(F.sum("docs").alias("hits"))
    kept = tokens.where(F.col("hits") >= constant * F.col("pairs")).groupBy(*group, "n", "pos").agg(F.min(F.struct((-F.col("hits")).alias("least"), "token")).alias("best"))
    many = kept.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("pos", "best.token"))).alias("_at"))
    many = many.select(*group, "n", F.transform(F.sequence(F.lit(0), t - 1), lambda i: F.element_at("_at", i)).alias("form"))
    return few.unionByName(many.where(enough(F.col("form"))).select(*group, "form"))


def _templates(rows: DataFrame, owners: DataFrame, tail: Column, depth: int, least: int, constant: float, similarity: float) -> DataFrame:
    """h1, h2, leaf1, leaf2, first: the lines that meet the generalised template
    of a group (leaf1, leaf2, grp) which recurs. ``owners`` are the documents of
    the lines that are in fewer than ``least``."""
    group = ["leaf1", "leaf2", "grp"]
    form = _forms(rows, tail, depth, constant, similarity)
    alike = F.size(F.filter(F.zip_with(tail, "form", lambda t, f: F.coalesce(t == f, F.lit(False))), lambda b: b))
    met = rows.join(cut(form, "forms"), group).where(alike >= similarity * (F.col("n") - depth))
    met = cut(met.select("h1", "h2", *group, "docs", "first"), "met")
    heads = cut(met.groupBy(*group).agg(F.max("docs").alias("most"), F.min("first").alias("lead")), "heads")
    # a line in enough documents settles its group; the lines of other groups are in few, which are counted
    doubt = met.join(heads.where(F.col("most") < least).select(*group), group, "left_semi").select("h1", "h2", *group)
    enough = owners.join(doubt, ["h1", "h2"]).select(*group, "doc").distinct().groupBy(*group).count().where(F.col("count") >= least).select(*group)
    sure = heads.where(F.col("most") >= least).select(*group).unionAll(enough)
    return met.join(cut(heads.join(sure, group).select(*group, "lead"), "general"), group).select("h1", "h2", "leaf1", "leaf2", F.col("lead").alias("first"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_generalised: int = 3, depth: int = 4, min_tokens: int = 1, constant: float = 0.5, similarity: float = 0.6, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """The columns of ``df`` with the text cleared of recurring lines, and
    the numbers of its lines and of those dropped (long), named by ``counts``."""
    if min_docs > min_generalised:
        raise ValueError("min_docs must be min_generalised at most, else one line alone may be a template that counts")
    id_, text = named(id_col, text_col)
    key = [id_.alias("_k"), F.xxhash64(text).alias("_t")]
    doc = F.struct("_k", "_t").alias("doc")
    texts = df.where(text.isNotNull()).select(*key, text.alias("text"))
    parsed = lambda ms: F.transform(ms, lambda m: F.struct(m.alias("m"), _tokens(m).alias("n")))
    lines_of = lambda t: _hashed(t.select(doc, F.posexplode(parsed(F.transform(F.split("text", "\n"), _masked))).alias("p", "x")), max(1, min_tokens), depth)
    slim = cut(lines_of(texts).drop("m"), "lines")
    once = slim.groupBy("h1", "h2", "leaf1", "leaf2", "n", "doc").agg(F.lit(1).alias("one"))  # a document's lines are in one task
    masked = cut(once.groupBy("h1", "h2", "leaf1", "leaf2", "n").agg(F.count("*").alias("docs"), F.min("doc").alias("first")), "templates")

    # leaves in which different lines meet, with positions beyond the leading tokens
    mixed = cut(masked.where(F.col("n") > depth).groupBy("leaf1", "leaf2").agg(F.sum("docs").alias("pairs"), F.count("*").alias("kinds")).where((F.col("kinds") > 1) & (F.col("pairs") >= min_generalised)), "mixed")
    inner = cut(masked.join(mixed, ["leaf1", "leaf2"]), "inner")
    slot = F.pmod(F.col("leaf1"), F.lit(LEAF_SLOTS)).alias("slot")
    some = F.broadcast(mixed.select(slot).distinct())
    # the texts of these lines are read where they come first
    place = lambda c: F.pmod(F.col(c), F.lit(LEAF_SLOTS)).alias("place")
    holders = texts.withColumn("place", place("_t")).join(F.broadcast(inner.select(place("first._t")).distinct()), "place", "left_semi")
    near = lines_of(holders).select("h1", "h2", "m", slot).join(some, "slot", "left_semi").groupBy("h1", "h2").agg(F.min("m").alias("m"))
    rows = cut(inner.join(near, ["h1", "h2"]), "leaves")
    owners = slim.select("h1", "h2", "doc", slot).join(some, "slot", "left_semi").select("h1", "h2", "doc")
    owners = owners.join(masked.where(F.col("docs") < min_generalised).select("h1", "h2"), ["h1", "h2"], "left_semi")
    tail = F.slice(F.split("m", " "), depth + 1, F.col("n") - depth)
    rows = cut(_promising(rows, tail, similarity), "leaves")
    found = lambda r: _templates(r, owners, tail, depth, min_generalised, constant, similarity)
    whole = cut(found(rows.withColumn("grp", F.lit(0).cast("long"))), "whole")
    # a group that changes anything holds a line which the whole leaf's template doesn't take
    settled = whole.select("h1", "h2")
    held, able = _groups(rows, settled, tail, depth, min_generalised, constant, similarity)
    group, line = ["leaf1", "leaf2", "grp"], ["h1", "h2"]
    # first the widest group of each open line, which mostly says all that the others can
    widest = cut(able.groupBy(*line).agg(F.max_by(F.struct(*group), F.struct("pairs", "grp")).alias("g")).select("g.*").distinct(), "widest")
    wide = cut(found(cut(_in_groups(rows, held, widest), "groups")), "wide")
    own = rows.where(F.col("docs") >= min_docs).select(*line, F.col("first").alias("lead"))
    known = own.unionAll(whole.unionAll(wide).select(*line, F.col("first").alias("lead"))).groupBy(*line).agg(F.min("lead").alias("lead"))
    doubt = cut(_in_doubt(held, able, rows, settled, cut(known, "known"), widest, min_generalised), "doubt")
    other = found(cut(_in_groups(rows, held, doubt), "groups"))
    general = whole.unionAll(wide).unionAll(other).select("h1", "h2", "first")

    recurring = masked.where(F.col("docs") >= min_docs).select("h1", "h2", "first").unionAll(general).groupBy("h1", "h2").agg(F.min("first").alias("first"))
    recurring = cut(recurring, "recurring")  # so that Spark may split the join for a hot line
    gone = slim.select("doc", "h1", "h2", "p").join(recurring, ["h1", "h2"]).where(F.col("doc") > F.col("first"))
    marks = gone.groupBy("doc").agg(F.collect_set("p").alias("_gone"))

    # lines travel as an array, so that the lambda below reads a stored column
    rest = [(i, c) for i, c in enumerate(df.columns) if c != text_col]
    keyed = df.select(F.struct(*key).alias("_doc"), F.split(text, "\n").alias("_l"), *[named(c)[0].alias(f"_c{i}") for i, c in rest])
    out = keyed.join(marks, keyed["_doc"].eqNullSafe(marks["doc"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), "_gone")
    left = F.when(F.col("_gone").isNull(), F.col("_l")).otherwise(F.transform(stay, lambda i: F.get("_l", i)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    cols = [F.array_join(left, "\n").alias(c) if c == text_col else F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)]
    return out.select(*cols, size("_l").alias(counts[0]), size("_gone").alias(counts[1]))
