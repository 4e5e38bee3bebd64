"""The queries opN_<name> over whole tables, and SQL for those that SQL can express.

Operators keep their general interface; a query only derives digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, line_dedup, piece_codec, quality_classifier, simhash_dedup, substring_dedup, token_counts, topk_search
from .common import table


def tokenizer_model() -> str:
    """Where the vocabulary file of the queries is (a parameter elsewhere)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_model(), limit=4096)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return language_id.language_id(table(spark, sf_dir, "documents"), held_out)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model())
    return piece_codec.digests(out)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_topk_search, op3_line_dedup, op4_token_counts, op5_language_id, op6_html_text, op7_quality_classifier, op8_decontamination, op9_piece_codec, op10_simhash_dedup)}

_OP1 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM words, unnest(range(1, len(w) - 33)) AS t(i)
), twice AS (
  SELECT r, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, i + o AS p FROM twice, unnest(range(0, 35)) AS t(o)
), each_word AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
  FROM each_word e ANTI JOIN gone g ON e.r = g.r AND e.p = g.p GROUP BY e.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""

_OP2 = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.r <> c.r
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

_OP3 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), parsed AS (
  SELECT doc_id, p, regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM lines
), counted AS (
  SELECT *, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:4], ' ') AS path
  FROM parsed WHERE m <> ''
), masked AS (
  SELECT m, t, n, path, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM counted GROUP BY ALL
), mixed AS (
  SELECT n, path FROM masked WHERE n > 4 GROUP BY n, path HAVING count(*) > 1 AND sum(docs) >= 3
), rows_in AS (
  SELECT a.* FROM masked a JOIN mixed b ON a.n = b.n AND a.path = b.path
), tokens AS (
  SELECT n, path, m, docs, first, generate_subscripts(t[5:], 1) - 1 AS pos, unnest(t[5:]) AS token FROM rows_in
), members AS (
  SELECT n, path, -1 AS gpos, '' AS gtoken, m, docs, first FROM rows_in
  UNION ALL
  SELECT t.n, t.path, t.pos, t.token, t.m, t.docs, t.first FROM tokens t
), grouped AS (
  SELECT *, sum(docs) OVER g AS pairs, count(*) OVER g AS kinds FROM members WINDOW g AS (PARTITION BY n, path, gpos, gtoken)
), sized AS (
  SELECT * FROM grouped WHERE kinds > 1 AND pairs >= 3
), spread AS (
  SELECT s.n, s.path, s.gpos, s.gtoken, s.pairs, s.m, s.docs, s.first, t.pos, t.token FROM sized s JOIN tokens t ON s.m = t.m
), form AS (
  SELECT n, path, gpos, gtoken, pos, token FROM spread GROUP BY n, path, gpos, gtoken, pairs, pos, token HAVING sum(docs) >= 0.5 * pairs
  QUALIFY row_number() OVER (PARTITION BY n, path, gpos, gtoken, pos ORDER BY sum(docs) DESC, token) = 1
), alike AS (
  SELECT s.n, s.path, s.gpos, s.gtoken, s.m, s.first
  FROM spread s JOIN form f ON s.n = f.n AND s.path = f.path AND s.gpos = f.gpos AND s.gtoken = f.gtoken AND s.pos = f.pos AND s.token = f.token
  GROUP BY ALL HAVING count(*) >= 0.6 * (s.n - 4)
), general AS (
  SELECT a.n, a.path, a.gpos, a.gtoken, min(a.first) AS first FROM alike a JOIN counted c ON a.m = c.m GROUP BY ALL HAVING count(DISTINCT c.doc_id) >= 3
), recurring AS (
  SELECT m, min(first) AS first FROM (
    SELECT m, first FROM masked WHERE docs >= 2
    UNION ALL
    SELECT a.m, g.first FROM alike a JOIN general g ON a.n = g.n AND a.path = g.path AND a.gpos = g.gpos AND a.gtoken = g.gtoken) GROUP BY m
), gone AS (
  SELECT DISTINCT c.doc_id, c.p FROM counted c JOIN recurring r ON c.m = r.m AND c.doc_id > r.first
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_dropped, string_agg(CASE WHEN g.p IS NULL THEN l.line END, chr(10) ORDER BY l.p) AS t
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLES = {"op1_substring_dedup": _OP1, "op2_topk_search": _OP2, "op3_line_dedup": _OP3}
