"""Queries of the training-data problems and, where SQL can say them, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakloom.llm import encode, leaks, overlap, splits, survivors, terms, toxic, variants
from wakloom.session import table


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = terms.term_frequency(table(spark, sf_dir, "review_queue"), "wak", "review_queue")
    return lines.unionAll(terms.term_frequency(table(spark, sf_dir, "override_draft"), "syllables", "override_draft"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marks(_counts(spark, sf_dir))


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).drop("term_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "override_entry")).select("group_id", "survivor_id", "syllables_from", "ipa_from")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "override_entry"))


def p2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "override_entry")
    one = lambda f: survivors.current_values(entries, f).select("group_id", F.lit(f).alias("field"), "value")
    return one("syllables").unionAll(one("ipa")).unionAll(one("note"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = variants.written_variants(table(spark, sf_dir, "review_queue"), "queue_id", "wak", "review_queue")
    return lines.unionAll(variants.written_variants(table(spark, sf_dir, "override_entry"), "entry_id", "word", "override_entry"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = variants.one_form(table(spark, sf_dir, "review_queue"), "queue_id", "wak", "review_queue")
    return lines.unionAll(variants.one_form(table(spark, sf_dir, "override_entry"), "entry_id", "word", "override_entry"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "eval_row"), table(spark, sf_dir, "stanza"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "eval_row"), table(spark, sf_dir, "stanza"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.linked_pairs(splits.chapter_groups(table(spark, sf_dir, "stanza")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.members(splits.chapter_groups(table(spark, sf_dir, "stanza")))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_rows(table(spark, sf_dir, "stanza"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text", spans=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "test_item"), table(spark, sf_dir, "documents"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_documents(table(spark, sf_dir, "test_item"), table(spark, sf_dir, "documents"), budget=2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label")).where("toxic").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxic_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_terms, p2_found, p2_records, p2_current, p3_found, p3_forms, p4_found, p4_report, p5_found, p5_groups, p5_splits, p8_ids, p8_spans, p9_found, p9_documents, p10_found, p10_scores, p10_rates)
}

_TERMS = """
WITH line AS (SELECT wak AS term, count(*) AS n_occ, count(*) AS n_rec FROM review_queue WHERE wak <> '' GROUP BY wak),
syll AS (SELECT draft_id, unnest(syllables) AS term FROM override_draft),
draft AS (SELECT term, count(*) AS n_occ, count(DISTINCT draft_id) AS n_rec FROM syll WHERE term <> '' GROUP BY term),
both_ AS (
  SELECT 'review_queue' AS src, *, (SELECT count(*) FROM review_queue WHERE wak <> '') AS n_records FROM line
  UNION ALL
  SELECT 'override_draft', *, (SELECT count(DISTINCT draft_id) FROM syll WHERE term <> '') FROM draft),
counted AS (SELECT *, n_occ <= 2 AS is_rare, n_rec * 100 > n_records AS is_common FROM both_)
"""

SQL = {
    "p1_terms": _TERMS + "SELECT src, term, n_occ, n_rec, n_records, is_rare, is_common FROM counted",
    "p1_found": _TERMS + "SELECT src, term, 'rare' AS mark FROM counted WHERE is_rare UNION ALL SELECT src, term, 'common' FROM counted WHERE is_common",
}
