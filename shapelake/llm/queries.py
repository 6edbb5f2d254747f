"""Queries of the text problems 3, 6, 7 and 8 over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm import mixing, residue, terms, tokens
from shapelake.session import table

# ---- 3: frequency of every term


def _term_fields():
    def sequence(name: str):
        return F.transform("failures", lambda x: terms.normal_term(x[name]))

    return {name: sequence(name) for name in ("code", "category", "stage")}


def _term_counts(spark: SparkSession, folder: str, max_n: int) -> tuple[DataFrame, DataFrame]:
    df = table(spark, folder, "screened_cases")
    return terms.ngram_frequency(df, "screen_id", _term_fields(), max_n, delivery=F.col("received_at")), df


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of failures.code, .category and .stage with its occurrences, screened cases and mark."""
    counts, df = _term_counts(spark, folder, 1)
    return terms.mark_terms(counts, df, "screen_id").select("field", F.col("term")[0].alias("term"), "occurrences", F.col("records").alias("cases"), "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common."""
    return p3_counts(spark, folder).filter("mark is not null").select("field", "term", "mark")


def p3_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of up to three terms of a screened case's failures with occurrences and screened cases."""
    counts, _ = _term_counts(spark, folder, 3)
    return counts.select("field", F.array_join("term", " ").alias("ngram"), "n", "occurrences", F.col("records").alias("cases"))


_P3_CTES = r"""
WITH f AS (SELECT screen_id, received_at, unnest(failures) AS x FROM screened_cases),
v AS (
  SELECT screen_id, received_at, 'code' AS field, x.code AS value FROM f
  UNION ALL SELECT screen_id, received_at, 'category', x.category FROM f
  UNION ALL SELECT screen_id, received_at, 'stage', x.stage FROM f),
t AS (
  SELECT screen_id, received_at, field, regexp_replace(regexp_replace(lower(value), '^\s+|\s+$', '', 'g'), '[\s\-_]+', '_', 'g') AS term FROM v),
p AS (SELECT field, term, screen_id, received_at, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL),
r AS (SELECT field, term, screen_id, CASE WHEN screen_id IS NULL THEN sum(n) ELSE max(n) END AS n FROM p GROUP BY field, term, screen_id),
c AS (SELECT field, term, sum(n)::BIGINT AS occurrences, count(screen_id) AS cases FROM r GROUP BY field, term),
m AS (
  SELECT *, CASE WHEN cases < 4 THEN 'rare' WHEN cases > 0.2 * (SELECT count(DISTINCT screen_id) FROM screened_cases) THEN 'common' END AS mark FROM c)
"""
P3_COUNTS_SQL = _P3_CTES + "SELECT field, term, occurrences, cases, mark FROM m"
P3_SQL = _P3_CTES + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL"

P3_NGRAMS_SQL = r"""
WITH v AS (
  SELECT screen_id, received_at, 'code' AS field, list_transform(failures, lambda x: x.code) AS s FROM screened_cases
  UNION ALL SELECT screen_id, received_at, 'category', list_transform(failures, lambda x: x.category) FROM screened_cases
  UNION ALL SELECT screen_id, received_at, 'stage', list_transform(failures, lambda x: x.stage) FROM screened_cases),
t AS (SELECT screen_id, received_at, field, list_filter(list_transform(s, lambda x: regexp_replace(regexp_replace(lower(x), '^\s+|\s+$', '', 'g'), '[\s\-_]+', '_', 'g')), lambda x: x <> '') AS s FROM v),
i AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM t),
g AS (SELECT screen_id, received_at, field, n, array_to_string(list_slice(s, i, i + n - 1), ' ') AS ngram FROM i, (VALUES (1), (2), (3)) k(n) WHERE i + n - 1 <= len(s)),
p AS (SELECT field, ngram, n, screen_id, received_at, count(*) AS c FROM g GROUP BY ALL),
r AS (SELECT field, ngram, n, screen_id, CASE WHEN screen_id IS NULL THEN sum(c) ELSE max(c) END AS c FROM p GROUP BY field, ngram, n, screen_id)
SELECT field, ngram, n, sum(c)::BIGINT AS occurrences, count(screen_id) AS cases FROM r GROUP BY field, ngram, n
"""

# ---- 6: encoding with a public tokenizer


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p6_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, tokens and texts that don't come back from their ids, per language."""
    docs = table(spark, folder, "documents")
    ids = tokens.encode_corpus(docs)
    back = tokens.decode_corpus(ids.withColumn("doc_id", F.struct("doc_id", F.size("ids").alias("n"))))
    both = back.select("doc_id.doc_id", F.col("doc_id.n").alias("n"), F.xxhash64("text").alias("h")).join(docs.select("doc_id", "lang", F.xxhash64(F.coalesce("text", F.lit(""))).alias("g")), "doc_id")
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit(""))
    return both.groupBy(lang.alias("lang")).agg(F.count("*").alias("documents"), F.sum("n").cast("bigint").alias("tokens"), F.count_if(F.col("h") != F.col("g")).alias("not_restored"))


# ---- 7: mixing sources to target weights


def _mixes(spark: SparkSession, folder: str):
    return mixing.mix_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix with their number of copies."""
    return _mixes(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of every source of every mix."""
    return mixing.mix_shares(*_mixes(spark, folder))


def p7_size_shares(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_shares, with mixes of the wished size whose sources at their cap fall short of their share."""
    mixed, plan = mixing.mix_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), priority="size")
    return mixing.mix_shares(mixed, plan)


# ---- 8: template residue and error pages


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue or filler, or that are only an error page or notice."""
    return residue.flag_residue(table(spark, folder, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that stay, per source: all, excluded as residue, excluded as messages, kept."""
    docs = table(spark, folder, "documents")
    flags = residue.flag_residue(docs)
    source = F.coalesce(mixing.clean_source(F.col("source")), F.lit(""))
    rows = docs.select("doc_id", source.alias("source")).join(flags, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("kind") == "residue").alias("residue"),
        F.count_if(F.col("kind") == "message").alias("messages"),
        F.count_if(F.col("kind").isNull()).alias("kept"),
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_ngrams": p3_ngrams,
    "p6_ids": p6_ids,
    "p6_stats": p6_stats,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_size_shares": p7_size_shares,
    "p8_found": p8_found,
    "p8_kept": p8_kept,
}
SQL = {"p3_found": P3_SQL, "p3_counts": P3_COUNTS_SQL, "p3_ngrams": P3_NGRAMS_SQL}
