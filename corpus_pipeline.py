"""A training corpus from raw documents: five stages, each over all rows that
the one before it kept.

The first four return the columns of ``documents``: quality and decontamination
drop documents, line de-duplication rewrites ``text`` (and ``n_chars``),
near-de-duplication (SimHash, and verified shingles) keeps the smallest document
of each group. The last returns what tokenisation
made of every document that is left.

Stages handle what their operators do: null texts are rejected as junk, null
ids are documents like others, rows with equal id and text are one document to
the de-duplicating stages. Extra columns are kept whatever their names. Empty
tables stay empty. Very long texts are handled whole, each in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, line_dedup, piece_codec, quality_classifier, shingle_links, simhash_dedup
from ledgerline.llm.common import cut, fresh, named, noting, remove, table
from ledgerline.llm.queries import tokenizer_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    quality = fresh(docs.columns, "_quality")
    scored = quality_classifier.score(docs, quality_classifier.train(docs), score_col=quality)
    return scored.where(F.col(quality) >= 0.5).select(named(*docs.columns))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, however short, that another, earlier document has."""
    counts = fresh(docs.columns, "_n_lines"), fresh(docs.columns, "_n_dropped")
    out = line_dedup.line_dedup(docs, counts=counts).drop(*counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(named(*docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group: texts
    with nearly equal fingerprints, or with 0.8 of their five-word shingles in
    common (verified), and what these connect."""
    key = F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_key")
    texts = docs.select(key, F.col("text"))
    groups = simhash_dedup.simhash_components(texts, "_key")
    near = groups.select(F.col("_key.h").alias("a"), F.col("component_id.h").alias("b")).where("a <> b").distinct()
    roots = simhash_dedup.components(near.unionAll(shingle_links.similar_links(texts)))
    rooted = texts.select("_key").distinct().join(roots.select(F.col("node").alias("_h"), "root"), F.col("_key.h") == F.col("_h"), "left")
    rooted = cut(rooted.select("_key", F.coalesce("root", "_key.h").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("_key").alias("_least")).select("_least")
    # by position, so that no name of a column matters
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named(*docs.columns))]).alias("_row")
    kept = docs.select(key, row).dropDuplicates(["_key"]).join(least, F.col("_key").eqNullSafe(F.col("_least")), "left_semi")
    return kept.select([F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    hits = fresh(docs.columns, "_hits")
    out = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), hits_col=hits)
    return out.where(F.size(hits) == 0).select(named(*docs.columns))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return piece_codec.digests(piece_codec.encode_decode(docs, tokenizer_model()))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_recurring_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("sentencepiece", tokenised),
]

#: The classifier, the fingerprints, the edit distances and the tokenizer have
#: no form in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's own
    tables and its input are deleted once its rows are written; those of the last
    stay, as its rows are still to be read."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with noting() as used:
            out = stage(spark, docs, sf_dir)
            with noting() as written:
                docs = cut(out, f"stage{i + 1}")
        remove(spark, used + before)
        before = written
    return docs
