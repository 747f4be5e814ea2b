"""The registered queries of this package: name -> query, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, best_fit, bin_slack, contamination, langid, lexical, ngram_join, quality
from . import secrets, separators, simhash, toxicity, warc
from .shared import drop_at_exit, fold, read, shared_path


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files in the shared folder, then counted from those files."""
    path = drop_at_exit(spark, shared_path(spark, "tokens"))
    separators.write_token_files(read(spark, sf_dir, "documents"), path)
    return separators.count_tokens(spark, path)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = fold("doc_id", 3)
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder != 1)
    return quality.score(docs, model).select(
        "doc_id", (remainder == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), all_items=True,
    ).drop("_a", "_h")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = fold("doc_id", 4)
    model = langid.train(docs, remainder != 2)
    return langid.identify(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(read(spark, sf_dir, "documents"))


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack_bin_slack(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = fold("doc_id", 4)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(read(spark, sf_dir, "pages"))
    return warc.page_records(warc.read_packages(packages))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_corpus(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select(*found.columns[:-1], digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_separator_scan": op4_separator_scan,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_bin_slack_packing": op9_bin_slack_packing,
    "op10_toxicity": op10_toxicity,
    "op11_warc": op11_warc,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}
# Words of a text in DuckDB's functions, as in `columns.word_list`.
_WORDS = r"""regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+')"""
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(text, '') AS text,
      regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
  grams AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(
        range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
      WHEN text <> '' THEN ['text without words: ' || text] ELSE ['empty: ' || doc_id] END AS g
    FROM words),
  classes AS (SELECT min(doc_id) AS c, count(*) AS copies, len(g) AS n, g FROM grams GROUP BY g),
  flat AS (SELECT c, copies, n, unnest(g) AS s FROM classes),
  links AS (
    SELECT x.c AS a, y.c AS b, any_value(y.copies) AS copies
    FROM flat x JOIN flat y ON x.s = y.s AND x.c <> y.c
    GROUP BY x.c, y.c HAVING 9 * count(*) >= 4 * (any_value(x.n) + any_value(y.n))),
  reached(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
  least AS (SELECT a AS c, min(b) AS b FROM reached GROUP BY a),
  numbers AS (SELECT a AS c, sum(copies) AS linked FROM links GROUP BY a)
SELECT doc_id, least(classes.c, coalesce(least.b, classes.c)) AS class_id,
  CAST(classes.copies - 1 + coalesce(linked, 0) AS BIGINT) AS n_links
FROM grams JOIN classes USING (g) LEFT JOIN least ON least.c = classes.c
LEFT JOIN numbers ON numbers.c = classes.c""",
    # an item is an id (or none) and a text; those of one to four words are one run of all their words
    "op6_decontamination": f"""
WITH d AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS t, {_WORDS} AS w FROM documents),
  b AS (SELECT DISTINCT item_id, md5(coalesce(text, '')) AS t, {_WORDS} AS w FROM benchmark),
  items AS (
    SELECT item_id, t, 5 AS width, unnest(list_distinct(list_transform(
      range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS run
    FROM b WHERE len(w) >= 5
    UNION ALL SELECT item_id, t, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
  sizes AS (SELECT item_id, t, count(*) AS n_shingles FROM items GROUP BY ALL),
  widths AS (SELECT DISTINCT width FROM items),
  runs AS (SELECT DISTINCT doc_id, t, width, array_to_string(w[i:i + width - 1], ' ') AS run
    FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM d CROSS JOIN widths))
SELECT doc_id, items.item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM runs JOIN items ON items.width = runs.width AND items.run = runs.run
JOIN sizes ON sizes.t = items.t AND sizes.item_id IS NOT DISTINCT FROM items.item_id
GROUP BY doc_id, runs.t, items.item_id, items.t, n_shingles
HAVING count(*) >= ceil(round(n_shingles * 0.8, 9))""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
  held AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
  counted AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
  total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms
    FROM d),
  weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))
    AS BIGINT) AS w FROM counted, total GROUP BY term),
  item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term
    FROM benchmark)),
  scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) //
      (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item JOIN counted USING (term) JOIN weight USING (term), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT)
  AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
}
