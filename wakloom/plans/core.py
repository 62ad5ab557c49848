"""Queries of the general data problems: two copies compared (p6), faulty records (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakloom.operators.diff import table_diff
from wakloom.operators.rejects import load_review
from wakloom.session import table

DICTIONARY_FIELDS = ["word", "syllables", "ipa", "n_seen", "reviewed", "updated_at"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_diff(table(spark, sf_dir, "overrides_main"), table(spark, sf_dir, "overrides_space"), ["word_id"], DICTIONARY_FIELDS, "only_main", "only_space")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("kind", "field").agg(F.count("*").alias("n_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_review(table(spark, sf_dir, "raw_review"))[1].select("raw_id", "reason")


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_review(table(spark, sf_dir, "raw_review"))[0]


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_review")
    faults = load_review(raw)[1].join(raw.select("raw_id", "file_name"), "raw_id")
    return faults.groupBy("file_name", "reason").agg(F.count("*").alias("n_records"))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p7_valid": p7_valid, "p7_counts": p7_counts}

_DIFF_SQL = """
WITH m AS (SELECT DISTINCT * FROM overrides_main), s AS (SELECT DISTINCT * FROM overrides_space),
one AS (SELECT m.word_id, 'only_main' AS kind, '' AS field FROM m WHERE word_id NOT IN (SELECT word_id FROM s)
  UNION ALL SELECT s.word_id, 'only_space', '' FROM s WHERE word_id NOT IN (SELECT word_id FROM m)),
""" + "pairs AS (SELECT m.word_id, " + ", ".join(f"m.{f} IS DISTINCT FROM s.{f} AS {f}" for f in DICTIONARY_FIELDS) + """ FROM m JOIN s USING (word_id)),
found AS (SELECT * FROM one UNION ALL """ + " UNION ALL ".join(f"SELECT word_id, 'differs', '{f}' FROM pairs WHERE {f}" for f in DICTIONARY_FIELDS) + ")"

_FIELD = '(?:[^",]*|"(?:[^"]|"")*")'
_BARE = r"regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]', '', 'g')"
_bare = _BARE.format
_REJECTS_SQL = (
    r"""
WITH r AS (SELECT raw_id, file_name, line, regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '\r?\n?\z', '') AS l FROM raw_review),
f AS (SELECT *, regexp_full_match(l, '(?s)FIELD(,FIELD)*') AS sound, 1 + length(regexp_replace(regexp_replace(l, '(?s)"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) AS n,
  list_transform(regexp_extract_all(l || ',', '(?s)(FIELD),', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v FROM r),
t AS (SELECT *, v[1] AS wak, v[2] AS syllables, v[3] AS flag, v[4] AS guess, v[5] AS a, v[6] AS b, v[7] AS c FROM f),
j AS (SELECT *, CASE WHEN line IS NULL THEN 'column_count' WHEN NOT sound THEN 'quoting' WHEN n <> 7 THEN 'column_count'
  WHEN NOT regexp_matches(wak, '[ก-ฮ]') OR contains(wak, '�') OR NOT regexp_full_match(syllables, '0*([1-9]|1[0-9]|20)') THEN 'value'
  WHEN A || B || C = '' OR (a IN ('x', 'X') AND B || C = '') OR (A <> '' AND B <> '' AND C <> '' AND A || B || C = W) THEN NULL ELSE 'value' END AS reason FROM t)
""".replace("FIELD", _FIELD).replace(" A ", f" {_bare('a')} ").replace("(A ", f"({_bare('a')} ").replace(" B ", f" {_bare('b')} ").replace(" C ", f" {_bare('c')} ").replace("= W)", f"= {_bare('wak')})")
)

SQL = {
    "p7_found": _REJECTS_SQL + " SELECT raw_id, reason FROM j WHERE reason IS NOT NULL",
    "p7_valid": _REJECTS_SQL + " SELECT raw_id, wak, syllables::INT AS syllables, flag, guess, a, b, c FROM j WHERE reason IS NULL",
    "p7_counts": _REJECTS_SQL + " SELECT file_name, reason, count(*) AS n_records FROM j WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": _DIFF_SQL + " SELECT word_id, kind, field FROM found",
    "p6_counts": _DIFF_SQL + " SELECT kind, field, count(*) AS n_words FROM found GROUP BY kind, field",
}
