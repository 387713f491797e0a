"""The ten operators as queries over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreef.llm import ann, jaccard, licenses, mixing, pieces, quality_model, quality_rules, token_counts, token_output, toxicity


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).drop("shard")


def example_edits() -> F.Column:
    """Edits of a text that touch its start, its middle and its end: a deletion of seven characters a third into it,
    an insertion of words in the middle, a replacement of its first word, an appended sentence."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("replacement"))
    third = F.floor(n / 3)
    return F.array(
        edit(third, third + 7, ""),
        edit(F.floor(n / 2), F.floor(n / 2), " as amended, it"),
        edit(F.lit(0), F.greatest(F.lit(0), F.locate(" ", F.coalesce("text", F.lit(""))) - 1), "Revised"),
        edit(F.lit(2**40), F.lit(2**40), "\n\nSee also: 2nd edition."),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", example_edits().alias("edits"))
    return token_counts.edited_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_token_output, op3_token_counts, op4_toxicity, op5_licenses, op6_pieces, op7_quality_rules, op8_nearest, op9_jaccard, op10_quality)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS times
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), again AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) AS s(k) WHERE times > 1 GROUP BY r
), m AS (
  SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
         len(list_filter(ws, lambda x: translate(x, '{_UPPER}', '{_LOWER}') IN ({", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}))) AS n_stop_words,
         length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits,
         coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) AS top_word
  FROM d LEFT JOIN again USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"({x})" for x in quality_rules.SQL_RULES.values())}) AS kept
FROM b
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
  WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), classes AS (
  SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN p.ws <> q.ws THEN q.ws END) AS n_texts, count(*) FILTER (WHERE p.ws = q.ws) AS n_copies
  FROM links JOIN d AS p ON p.doc_id = a JOIN d AS q ON q.doc_id = b GROUP BY a
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts, coalesce(n_copies, 0) AS n_copies
FROM d LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORACLE_SQL = {"op7_quality_rules": OP7_SQL, "op9_jaccard": OP9_SQL}
