"""Queries of the rules, the dictionary build and the evaluation tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakloom.functions import text as X
from wakloom.functions.phonology import syllable_classes
from wakloom.operators import evaluation, lexicon, meter, segment, structure, validator
from wakloom.plans.verse import LINES_SQL, lines_of
from wakloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Syllables with their vowel and final class, and pairs that rhyme or do not.
SOUNDS = {
    "เลย": "เออ เกย", "พวก": "อัว กก", "เจ็ด": "เอะ กด", "แข็ง": "แอะ กง", "ก็": "เอาะ กา", "พาล": "อา กน", "ไกล": "ไอ กา", "ไกว": "ไอ กา", "โปร": "โอ กา", "เริง": "เออ กง", "สาว": "อา เกอว", "ทำ": "อำ กา",
    "ควร": "อัว กน", "เสือ": "เอือ กา", "เรียน": "เอีย กน", "โต๊ะ": "โอะ กา", "พร": "ออ กน", "นม": "โอะ กม", "ฤทธิ์": "อิ กด", "กรรม": "อำ กม", "สรร": "อะ กน", "บ่": "ออ กา", "ณ": "อะ กา", "มือ": "อือ กา", "น้ำ": "อำ กา",
    "ชาติ": "อา กด", "จันทร์": "อะ กน", "เกาะ": "เอาะ กา", "เมา": "เอา กา", "เออะ": "เออะ กา", "ตัว": "อัว กา", "เขว": "เอ กา", "เลว": "เอ เกอว", "เพล": "เอ กน", "บุตร": "อุ กด", "มังกร": "อะ กน", "จักร": "อะ กก", "ศาสตร์": "อา กด",
    "วุฒิ": "อุ กด", "ธาตุ": "อา กด", "เมรุ": "เอ กน", "ภูมิ": "อู กม", "โพธิ": "โอ กด",
}
PAIRS = [("บ้าน", "พาล", True), ("ธรรม", "สัม", True), ("ธรรม", "จำ", True), ("กัย", "ไก", True), ("ใจ", "ไทย", True), ("สรร", "อัน", True), ("จำ", "กรรม", True), ("หมาย", "พอง", False), ("เพชร", "เพ็ด", False), ("ศัตรู", "ครู", False), ("กษัตรี", "ตรี", False)]
WEIGHTS = {"บ่": "lahu", "ณ": "lahu", "ก็": "lahu", "โต๊ะ": "lahu", "พาล": "karu", "น้ำ": "karu", "วุฒิ": "karu", "มือ": "karu", "ธ": "lahu", "ทำ": "karu"}


def _values(rows: list[tuple]) -> str:
    word = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(word, r)) + ")" for r in rows) + ")"


@query(f"SELECT * FROM {_values([(w, c.split()[0]) for w, c in SOUNDS.items()])} t(word, vowel)")
def pho_sara(spark, sf_dir):
    return syllable_classes(spark.createDataFrame([(w,) for w in SOUNDS], "word string"), "word").select("word", "vowel")


@query(f"SELECT * FROM {_values([(w, c.split()[1]) for w, c in SOUNDS.items()])} t(word, final_class)")
def pho_marttra(spark, sf_dir):
    return syllable_classes(spark.createDataFrame([(w,) for w in SOUNDS], "word string"), "word").select("word", "final_class")


@query(f"SELECT * FROM {_values(list(WEIGHTS.items()))} t(word, weight)")
def pho_karu_lahu(spark, sf_dir):
    return syllable_classes(spark.createDataFrame([(w,) for w in WEIGHTS], "word string"), "word").select("word", "weight")


@query(f"SELECT * FROM {_values(PAIRS)} t(first, second, rhymes)")
def rule_is_sumpus(spark, sf_dir):
    from wakloom.functions.phonology import classes

    pairs = spark.createDataFrame([(a, b) for a, b, _ in PAIRS], "first string, second string").withColumns({"a": F.array("first"), "b": F.array("second")})
    return validator.compared(pairs, "a", "b", classes).select("first", "second", "rhymes")


_BARE = "translate(x, '่้๊๋', '')"
_QUADS = f"""WITH e AS (SELECT entry_id // 4 AS poem, entry_id % 4 AS j, list_filter(coalesce(syllables, []), lambda x: x IS NOT NULL) AS s FROM override_entry),
p AS (SELECT poem, any_value(s) FILTER (j = 0) AS w1, any_value(s) FILTER (j = 1) AS w2, any_value(s) FILTER (j = 2) AS w3, any_value(s) FILTER (j = 3) AS w4 FROM e GROUP BY poem HAVING count(*) = 4),
k AS (SELECT *, list_transform(w1, lambda x: {_BARE}) AS k1, list_transform(w2, lambda x: {_BARE}) AS k2, list_transform(w3, lambda x: {_BARE}) AS k3, list_transform(w4, lambda x: {_BARE}) AS k4 FROM p)"""


def _poems(spark, sf_dir) -> DataFrame:
    """Four entries that follow each other by id make a stanza, each a line; the key of a syllable is the syllable without tones."""
    e = table(spark, sf_dir, "override_entry").select("entry_id", F.filter(F.coalesce("syllables", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("s"))
    line = F.struct("entry_id", "s", F.transform("s", X.without_tones).alias("k"))
    four = e.groupBy(F.floor(F.col("entry_id") / 4).alias("poem")).agg(F.array_sort(F.collect_list(line)).alias("p")).where("size(p) = 4")  # ids are unique: four at most
    return four.select("poem", F.transform("p", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"))).alias("p"))


def _told(kind: int) -> str:
    n2, n4 = ("5", "5") if kind == 8 else ("(CASE WHEN len(w2) = 5 THEN 3 ELSE 2 END)", "(CASE WHEN len(w4) = 5 THEN 3 ELSE 2 END)")
    most = 10 if kind == 8 else 5
    shown = lambda a: f"'[''' || array_to_string({a}, ''', ''') || ''']'"
    long = ", ".join(f"CASE WHEN len(w{i}) > {most} THEN 'Stanza (บทที่) 1 Wak {i}: Word count exceeds {most}: ' || {shown(f'w{i}')} END" for i in (1, 2, 3, 4))
    off = lambda a, b, told: f"'Rhyme error in Stanza (บทที่) 1: ''' || w{a}[-1] || ''' (Wak {a}) does not rhyme with ' || {told} || ' (Wak {b})'"
    return f"""list_filter([{long},
  CASE WHEN NOT list_contains(k2[1:{n2}], k1[-1]) THEN {off(1, 2, shown(f"w2[1:{n2}]"))} END, CASE WHEN k2[-1] <> k3[-1] THEN {off(2, 3, "'''' || w3[-1] || ''''")} END,
  CASE WHEN NOT list_contains(k4[1:{n4}], k3[-1]) THEN {off(3, 4, shown(f"w4[1:{n4}]"))} END], lambda x: x IS NOT NULL)"""


def _messages_sql(kind: int) -> str:
    return _QUADS + f""", m AS (SELECT poem, CASE WHEN len(w1) * len(w2) * len(w3) * len(w4) = 0 THEN ['Stanza (บทที่) 1 contains empty sentences.'] ELSE {_told(kind)} END AS m FROM k)
SELECT poem, array_to_string(CASE WHEN len(m) = 0 THEN ['{validator.SOUND}'] ELSE m END, '; ') AS messages FROM m"""


@query(_messages_sql(8))
def rule_check_klon(spark, sf_dir):
    return _poems(spark, sf_dir).select("poem", F.array_join(validator.messages(F.col("p"), 8), "; ").alias("messages"))


@query(_messages_sql(4))
def rule_check_klon_four(spark, sf_dir):
    return _poems(spark, sf_dir).select("poem", F.array_join(validator.messages(F.col("p"), 4), "; ").alias("messages"))


@query(_QUADS + """, c AS (SELECT poem, len(w1) * len(w2) * len(w3) * len(w4) > 0 AS full_, list_contains(k2[1:2], k1[-1]) OR (len(k2) = 5 AND k2[3] = k1[-1]) AS r1, k2[-1] = k3[-1] AS r2, list_contains(k4[1:2], k3[-1]) OR (len(k4) = 5 AND k4[3] = k3[-1]) AS r3,
  (len(w1) IN (4, 5))::INT + (len(w2) IN (4, 5))::INT + (len(w3) IN (4, 5))::INT + (len(w4) IN (4, 5))::INT AS meter, (len(w1) BETWEEN 1 AND 5)::INT + (len(w2) BETWEEN 1 AND 5)::INT + (len(w3) BETWEEN 1 AND 5)::INT + (len(w4) BETWEEN 1 AND 5)::INT AS words FROM k),
n AS (SELECT poem, 9 + CASE WHEN full_ THEN 3 ELSE 0 END AS total_checks, meter + words + 1 + CASE WHEN full_ THEN coalesce(r1, false)::INT + coalesce(r2, false)::INT + coalesce(r3, false)::INT ELSE 0 END AS passed_checks FROM c)
SELECT *, round_even(100 * passed_checks / total_checks, 0)::INT AS score, CASE WHEN passed_checks < total_checks THEN 'ไม่ผ่าน' ELSE 'ผ่าน' END AS verdict FROM n""")  # fmt: skip
def rule_report(spark, sf_dir):
    """Of klon of four, as entries have few syllables."""
    return validator.report(_poems(spark, sf_dir), "p", 4).select("poem", "passed_checks", "total_checks", "score", "verdict")


@query("""SELECT entry_id, coalesce(len(syllables), 0) AS n, CASE len(syllables) WHEN 4 THEN '2-2' WHEN 5 THEN '2-3' END AS rhythm,
CASE WHEN len(syllables) = 4 THEN array_to_string([array_to_string(syllables[1:2], '-'), array_to_string(syllables[3:4], '-')], ' ') WHEN len(syllables) = 5 THEN array_to_string([array_to_string(syllables[1:2], '-'), array_to_string(syllables[3:5], '-')], ' ') ELSE coalesce(array_to_string(syllables, '-'), '') END AS groups FROM override_entry""")
def rule_meter(spark, sf_dir):
    s = F.coalesce("syllables", F.array().cast("array<string>"))
    beats = validator.rhythm(F.size(s), 4)
    return table(spark, sf_dir, "override_entry").select("entry_id", F.size(s).alias("n"), F.array_join(F.transform(beats, lambda b: b.cast("string")), "-").alias("rhythm"), F.array_join(validator.beat_groups(s, beats), " ").alias("groups"))


@query("""WITH e AS (SELECT entry_id // 3 AS line, entry_id, coalesce(word, '') AS w, coalesce(len(syllables), 0) AS n FROM override_entry), l AS (SELECT line, list(n ORDER BY entry_id) AS ns, sum(n)::INT AS n FROM e GROUP BY line),
a AS (SELECT *, len(list_filter(ns, lambda x: x >= 4)) AS longs FROM l)
SELECT line, n AS n_syllables, CASE WHEN n <= 6 THEN 'opener' WHEN n <= 9 THEN 'body' ELSE 'irregular' END AS kind,
CASE WHEN n = 7 THEN '3,2,2' WHEN n = 8 THEN '3,2,3' WHEN n = 9 AND longs = 0 THEN '3,3,3' WHEN n = 9 AND longs = 1 AND ns[1] >= 4 THEN '4,2,3' WHEN n = 9 AND longs = 1 AND ns[-1] >= 4 THEN '3,2,4' END AS rhythm,
CASE WHEN n <= 6 THEN 'opener (<=6 syllables) — short วรรค, expected' WHEN n >= 10 THEN n || ' syllables — likely shatter/miscount' WHEN n = 7 THEN '7 syllables — ambiguous, [3,2,2] is only a guess'
WHEN n = 9 AND longs > 0 AND NOT (longs = 1 AND (ns[1] >= 4 OR ns[-1] >= 4)) THEN '4-syllable word not at วรรค edge' END AS note FROM a""")
def rule_line_words(spark, sf_dir):
    """Three entries that follow each other by id make a line of words with their syllables' numbers."""
    e = table(spark, sf_dir, "override_entry").select("entry_id", F.coalesce("word", F.lit("")).alias("w"), F.greatest(F.size(F.coalesce("syllables", F.array().cast("array<string>"))), F.lit(0)).alias("n"))
    word = F.struct("entry_id", "w", "n")
    lines = e.groupBy(F.floor(F.col("entry_id") / 3).alias("line")).agg(F.array_sort(F.collect_list(word)).alias("x"))  # ids are unique: three at most
    none = F.lit(None)
    made = lines.select("line", F.transform("x", lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), none.cast("array<int>").alias("alts"), none.cast("array<struct<w:string,n:int>>").alias("pieces"))).alias("words"))
    out = meter.line_analysis(made, "words")
    note = F.get(F.filter("flags", lambda f: f != "word straddles a beat boundary"), F.lit(0))
    return out.select("line", "n_syllables", "kind", F.array_join(F.transform("rhythm", lambda x: x.cast("string")), ",").alias("rhythm"), note.alias("note"))


_SCREEN = r"""WITH p AS (SELECT e.entry_id, e.word, e.syllables AS s, d.syllables AS z FROM override_entry e JOIN (SELECT word, arg_min(syllables, entry_id) AS syllables, min(entry_id) AS first_id FROM override_entry WHERE syllables IS NOT NULL AND NOT list_contains(list_transform(syllables, lambda x: x IS NULL), true) GROUP BY word) d ON e.word = d.word WHERE e.entry_id <> d.first_id AND len(e.syllables) >= 2 AND NOT list_contains(list_transform(e.syllables, lambda x: x IS NULL), true)),
t AS (SELECT *, length(regexp_replace(word, '[^่้๊๋]', '', 'g')) AS lost, length(regexp_replace(array_to_string(s, ''), '[^่้๊๋]', '', 'g')) AS kept FROM p)"""


@query(_SCREEN + r""" SELECT entry_id, len(s) AS n, len(z) AS n_spelled,
array_to_string(list_filter([CASE WHEN kept < lost THEN 'tone lost ' || lost || '→' || kept END], lambda x: x IS NOT NULL) || flatten(list_transform(s, lambda o, i: list_filter([CASE WHEN length(o) < 2 THEN '1-char syllable @' || i || ' (' || o || ')' END, CASE WHEN regexp_matches(o, 'ำ[ก-ฮ]$') THEN 'redundant ำ+cons @' || i END, CASE WHEN regexp_matches(o, '[ก-ฮ][ใไ]ย$') THEN 'redundant ไ/ใ+ย @' || i END, CASE WHEN regexp_matches(o, 'เ[ก-ฮ]าว$') THEN 'redundant เ-า+ว @' || i END], lambda x: x IS NOT NULL)))
 || CASE WHEN len(z) = 0 THEN [] WHEN len(z) > len(s) THEN ['ssg splits more than override (' || len(z) || ' vs ' || len(s) || ')'] WHEN len(z) < len(s) THEN ['syllable count differs (ssg ' || len(z) || ' vs w2p ' || len(s) || ')']
 ELSE flatten(list_transform(s, lambda o, i: list_filter([CASE WHEN regexp_replace(z[i], '[^่้๊๋]', '', 'g') <> '' AND regexp_replace(o, '[^่้๊๋]', '', 'g') <> '' AND regexp_replace(z[i], '[^่้๊๋]', '', 'g') <> regexp_replace(o, '[^่้๊๋]', '', 'g') THEN 'tone changed @' || i || ' (' || z[i] || ' vs ' || o || ')' END,
   CASE WHEN length(z[i]) >= 2 AND NOT contains(z[i], '์') AND translate(z[i], '่้๊๋', '') <> translate(o, '่้๊๋', '') THEN 'sound mismatch @' || i || ' (' || z[i] || ' vs ' || o || ')' END], lambda x: x IS NOT NULL))) END, '; ') AS flags FROM t""")  # fmt: skip
def rule_screening(spark, sf_dir):
    """Entries against the first division of the same word; alike here means equal without tones."""
    alike = lambda a, b: X.without_tones(a) == X.without_tones(b)
    full = lambda c: ~F.exists(c, lambda x: x.isNull())
    d = table(spark, sf_dir, "override_entry").where(F.col("syllables").isNotNull() & full("syllables")).groupBy("word").agg(F.min_by("syllables", "entry_id").alias("z"), F.min("entry_id").alias("first_id"))
    e = table(spark, sf_dir, "override_entry").select("entry_id", "word", F.col("syllables").alias("s")).where((F.size("s") >= 2) & full("s")).join(d, "word").where("entry_id <> first_id")
    return e.select("entry_id", F.size("s").alias("n"), F.size("z").alias("n_spelled"), F.array_join(lexicon.screening_flags(F.col("word"), F.col("s"), F.col("z"), alike), "; ").alias("flags"))


@query("""WITH s AS (SELECT syllables, CASE WHEN length(word) = 1 THEN 'single' WHEN len(syllables) = 1 THEN 'one_syllable' ELSE 'dropped' END AS part FROM override_entry) SELECT part, count(*) AS n FROM s GROUP BY part""")
def prj_building_blocks(spark, sf_dir):
    return lexicon.building_blocks(table(spark, sf_dir, "override_entry").select("word", "syllables")).groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT syllable FROM (SELECT unnest(syllables) AS syllable FROM override_draft)) SELECT syllable FROM s WHERE length(syllable) BETWEEN 2 AND 6 AND regexp_full_match(syllable, '[฀-๿]+') AND NOT regexp_matches(syllable, '[๐-๙ฯๆ]') AND syllable NOT IN (SELECT word FROM overrides_main WHERE word IS NOT NULL)
AND (NOT regexp_matches(syllable, '[ฤฦ]') OR syllable IN (SELECT word FROM override_entry WHERE len(syllables) = 1))""")
def prj_clean_candidates(spark, sf_dir):
    pool = table(spark, sf_dir, "override_draft").select(F.explode("syllables").alias("syllable")).distinct()
    none = spark.createDataFrame([], "syllable string")
    return lexicon.clean_candidates(pool, "syllable", table(spark, sf_dir, "overrides_main").select("word"), none, table(spark, sf_dir, "override_entry").select("word", "syllables"))


@query("""WITH t AS (SELECT unnest(syllables) AS w FROM override_entry), p AS (SELECT w, count(*) AS n FROM t WHERE w IS NOT NULL GROUP BY w), h AS (SELECT *, w IN (SELECT word FROM overrides_main WHERE word IS NOT NULL) AS has FROM p)
SELECT sum(n)::BIGINT AS n_tokens, coalesce(sum(n) FILTER (has), 0)::BIGINT AS n_covered, count(*) AS n_words, count(*) FILTER (NOT has) AS n_words_left, (sum(n) - coalesce(sum(n) FILTER (has), 0))::BIGINT AS n_left, round(100 * coalesce(sum(n) FILTER (has), 0) / sum(n), 2) AS percent FROM h""")
def agg_coverage(spark, sf_dir):
    tokens = table(spark, sf_dir, "override_entry").select(F.explode("syllables").alias("w"))
    return lexicon.coverage(tokens, "w", table(spark, sf_dir, "overrides_main"))


@query("""WITH f AS (SELECT word, n_seen AS freq, length(word) = 1 AS composed, len(syllables) = 1 AS changed, CASE WHEN contains(word, '์') THEN 1 ELSE 0 END AS flags FROM override_draft),
b AS (SELECT freq, CASE WHEN coalesce(composed, false) THEN 'COMPOSED' WHEN flags > 0 AND changed THEN 'FIXED' WHEN flags > 0 THEN 'REVIEW' WHEN freq < 2 THEN 'SKIP' ELSE 'AUTO' END AS bucket FROM f), n AS (SELECT bucket, count(*) AS n_words, sum(freq)::BIGINT AS n_occurrences FROM b GROUP BY bucket)
SELECT *, round(100 * n_occurrences / (SELECT sum(n_occurrences) FROM n), 2) AS percent FROM n""")
def agg_buckets(spark, sf_dir):
    f = table(spark, sf_dir, "override_draft").select("word", F.col("n_seen").alias("freq"), (F.length("word") == 1).alias("composed"), (F.size("syllables") == 1).alias("changed"), F.when(F.col("word").contains("์"), F.array(F.lit("silenced"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return lexicon.bucket_sizes(lexicon.buckets(f, "freq", "flags", "changed", "composed"), "freq")


@query(LINES_SQL + """, one AS (SELECT chapter, section, count(*) AS n FROM sect WHERE section IS NOT NULL GROUP BY chapter, section)
SELECT chapter, count(*) AS n_sections, count(*) FILTER (n % 4 NOT IN (0, 3)) AS sections_skipped, sum(CASE WHEN n % 4 IN (0, 3) THEN n // 4 ELSE 0 END)::BIGINT AS n_stanzas FROM one GROUP BY chapter""")
def agg_export_stats(spark, sf_dir):
    s = structure.section_sizes(lines_of(spark, sf_dir)).withColumn("rest", F.col("n_lines") % 4)
    return s.groupBy("chapter").agg(F.count("*").alias("n_sections"), F.count_if(~F.col("rest").isin(0, 3)).alias("sections_skipped"), F.sum(F.when(F.col("rest").isin(0, 3), F.floor(F.col("n_lines") / 4)).otherwise(0)).alias("n_stanzas"))


@query(LINES_SQL + """, c AS (SELECT chapter, count(*) AS n, max(CASE WHEN section = 0 AND size % 4 = 3 THEN 3 ELSE 0 END) AS opener_cut FROM sect GROUP BY chapter) SELECT chapter, opener_cut, (n - opener_cut) // 4 AS kept, (n - opener_cut) % 4 AS tail_dropped FROM c""")
def agg_eval_stats(spark, sf_dir):
    cut = F.max(F.when((F.col("section") == 0) & (F.col("size") % 4 == 3), 3).otherwise(0))
    c = structure.sections(lines_of(spark, sf_dir)).groupBy("chapter").agg(F.count("*").alias("n"), cut.alias("opener_cut"))
    body = F.col("n") - F.col("opener_cut")
    return c.select("chapter", "opener_cut", F.floor(body / 4).alias("kept"), (body % 4).alias("tail_dropped"))


_JUDGED = """WITH q AS (SELECT chapter, coalesce(nullif(split_part(flag, ' ', 1), ''), 'none') AS op, flag IS NOT NULL AND flag <> '' AS gold, CASE WHEN syllables IS NULL THEN NULL ELSE syllables NOT BETWEEN 8 AND 9 END AS pred FROM review_queue)"""


def _judged(spark, sf_dir) -> DataFrame:
    first = F.get(F.split("flag", " "), F.lit(0))
    return table(spark, sf_dir, "review_queue").select("chapter", F.when(F.coalesce(first, F.lit("")) == "", "none").otherwise(first).alias("op"), (F.col("flag").isNotNull() & (F.col("flag") != "")).alias("gold"), (~F.col("syllables").between(8, 9)).alias("pred"))


_Z = "1.96"


def _wilson_sql(k: str, n: str, name: str) -> str:
    p, m = f"({k} / {n})", f"(({k} / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))"
    half = f"({_Z} * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n}) / (1 + 3.8416 / {n}))"
    return f"CASE WHEN {n} > 0 THEN round({m} - {half}, 6) END AS {name}_low, CASE WHEN {n} > 0 THEN round({m} + {half}, 6) END AS {name}_high"


@query(_JUDGED + f""", c AS (SELECT chapter, count(*) AS n_instances, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp, count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn, count(*) FILTER (pred IS NULL) AS dropped FROM q GROUP BY chapter)
SELECT chapter, n_instances, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) END AS accuracy, {_wilson_sql('tp', '(tp + fp)', 'precision')}, {_wilson_sql('tp', '(tp + fn)', 'recall')},
CASE WHEN tp + fp + dropped > 0 THEN round(tp / (tp + fp + dropped), 6) END AS safe_precision, CASE WHEN tp + fn + dropped > 0 THEN round(tp / (tp + fn + dropped), 6) END AS safe_recall FROM c""")
def agg_summary(spark, sf_dir):
    out = evaluation.summary(_judged(spark, sf_dir), ["chapter"])
    return out.select("chapter", "n_instances", "accuracy", "precision_low", "precision_high", "recall_low", "recall_high", "safe_precision", "safe_recall")


@query(_JUDGED + """ SELECT op, count(*) AS n, count(*) FILTER (NOT gold AND coalesce(pred, false)) AS fp, count(*) FILTER (gold AND NOT coalesce(pred, false)) AS fn, CASE WHEN count(*) FILTER (gold) > 0 THEN round(count(*) FILTER (gold AND coalesce(pred, false)) / count(*) FILTER (gold), 6) END AS recall FROM q GROUP BY op""")
def agg_by_operator(spark, sf_dir):
    return evaluation.by_operator(_judged(spark, sf_dir), ["op"])


@query("""SELECT story, edition, count(*) AS n, round(100 * count(*) FILTER (prev_w4 IS NOT NULL) / greatest(count(*), 1), 2) AS accepted FROM stanza GROUP BY story, edition""")
def agg_accept_rate(spark, sf_dir):
    return table(spark, sf_dir, "stanza").groupBy("story", "edition").agg(F.count("*").alias("n"), F.count("prev_w4").alias("k")).select("story", "edition", "n", evaluation.accept_rate(F.col("k"), F.col("n")).alias("accepted"))


@query("""WITH e AS (SELECT story, chapter, arg_max(w4, ("row", stanza_id)) AS last_w4, arg_min(w2, ("row", stanza_id)) AS first_w2, TRY_CAST(regexp_extract(chapter, '([0-9]+)', 1) AS INT) AS number FROM stanza WHERE w4 IS NOT NULL AND w2 IS NOT NULL GROUP BY story, chapter),
n AS (SELECT *, lead(chapter) OVER w AS next_chapter, lead(first_w2) OVER w AS next_w2 FROM e WINDOW w AS (PARTITION BY story ORDER BY number NULLS FIRST, chapter)),
s AS (SELECT *, right(last_w4, 1) = right(next_w2, 1) AS ok FROM n WHERE next_chapter IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY story, coalesce(ok, false) ORDER BY number NULLS FIRST, chapter) AS k FROM s)
SELECT story, count(*) AS boundaries, count(*) FILTER (ok) AS rhyme, count(*) FILTER (NOT coalesce(ok, false)) AS n_exceptions, coalesce(string_agg(chapter || '|' || next_chapter, ' ' ORDER BY k) FILTER (NOT coalesce(ok, false) AND k <= 10), '') AS exceptions FROM x GROUP BY story""")  # fmt: skip
def agg_seam_summary(spark, sf_dir):
    seams = structure.chapter_bounds(table(spark, sf_dir, "stanza").where("w4 is not null and w2 is not null"), X.number_in("chapter"))
    seams = seams.withColumn("ok", F.right("last_w4", F.lit(1)) == F.right("next_w2", F.lit(1)))
    out = evaluation.seam_summary(seams, "ok", ["story"], ["number", "chapter"], ["chapter", "next_chapter"])
    return out.withColumn("exceptions", F.array_join("exceptions", " "))


@query("SELECT edition, count(*) AS n, round_even(100 * count(*) / (SELECT count(*) FROM stanza), 1) AS percent FROM stanza GROUP BY edition")
def agg_shares(spark, sf_dir):
    return evaluation.shares(table(spark, sf_dir, "stanza").select("edition"), ["edition"])


@query("""WITH m AS (SELECT DISTINCT word_id, reviewed, n_seen > 10 AS often FROM overrides_main), s AS (SELECT DISTINCT word_id, reviewed, n_seen > 10 AS often FROM overrides_space),
j AS (SELECT m.reviewed AS a1, s.reviewed AS b1, m.often AS a2, s.often AS b2 FROM m JOIN s USING (word_id)), c AS (SELECT 'reviewed' AS "check", a1 AS a, b1 AS b FROM j UNION ALL SELECT 'often', a2, b2 FROM j)
SELECT "check", CASE WHEN a IS NULL OR b IS NULL THEN 'bail' WHEN a = b THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM c GROUP BY ALL""")
def agg_parity(spark, sf_dir):
    m, s = (table(spark, sf_dir, f"overrides_{x}").select("word_id", "reviewed", (F.col("n_seen") > 10).alias("often")).distinct() for x in ("main", "space"))
    return evaluation.parity(m, s, ["word_id"], ["reviewed", "often"])


@query("""WITH v AS (SELECT w1, w2, w3, w4, min(stanza_id) AS stanza_id FROM stanza GROUP BY ALL) SELECT e.eval_id, v.stanza_id FROM eval_row e LEFT JOIN v ON e.w1 IS NOT DISTINCT FROM v.w1 AND e.w2 IS NOT DISTINCT FROM v.w2 AND e.w3 IS NOT DISTINCT FROM v.w3 AND e.w4 IS NOT DISTINCT FROM v.w4""")
def join_verdicts(spark, sf_dir):
    lines = ["w1", "w2", "w3", "w4"]
    v = table(spark, sf_dir, "stanza").groupBy(*lines).agg(F.min("stanza_id").alias("stanza_id"))
    return evaluation.join_verdicts(table(spark, sf_dir, "eval_row").select("eval_id", *lines), v, lines, ["stanza_id"]).select("eval_id", "stanza_id")


_PARTS = "WITH s AS (SELECT DISTINCT syllable, right(syllable, 1) AS tail, left(syllable, 1) AS head FROM (SELECT unnest(syllables) AS syllable FROM override_entry) WHERE syllable <> '')"


def _parts(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "override_entry").select(F.explode("syllables").alias("syllable")).where("syllable <> ''").distinct()
    return s.select("syllable", F.right("syllable", F.lit(1)).alias("tail"), F.left("syllable", F.lit(1)).alias("head"))


@query(_PARTS + ", f AS (SELECT tail, head, min(encode(syllable)) AS c FROM s GROUP BY tail, head) SELECT s.syllable AS target, decode(f.c) AS candidate FROM s JOIN f ON s.tail = f.tail WHERE s.head <> f.head AND decode(f.c) <> s.syllable")
def join_traps(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return evaluation.traps(p, p, "syllable", "tail", "head")


@query(_PARTS + ", a AS (SELECT DISTINCT head, tail FROM s WHERE length(syllable) = 3) SELECT syllable FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.head = s.head AND a.tail = s.tail)")
def join_not_avoided(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return evaluation.not_avoided(p, p.where("length(syllable) = 3"), "head", "tail").select("syllable")


@query("""WITH m AS (SELECT DISTINCT word, ipa FROM overrides_main WHERE word <> ipa) SELECT word, ipa FROM m WHERE NOT EXISTS (SELECT 1 FROM overrides_space s WHERE s.word = m.word AND s.ipa = m.ipa)""")
def join_unused_pairs(spark, sf_dir):
    return evaluation.unused(table(spark, sf_dir, "overrides_main").select("word", "ipa").distinct(), table(spark, sf_dir, "overrides_space"), "word", "ipa")


@query(r"""SELECT queue_id, replace(replace(replace(replace(replace(flag, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, left(wak, 10) AS preview, CASE WHEN wak IS NULL THEN NULL WHEN length(wak) < 3 OR instr(substr(wak, 3), 'ก') = 0 THEN 0 ELSE instr(substr(wak, 3), 'ก') + 2 END AS next_k,
len(list_filter(regexp_split_to_array(replace(coalesce(guess, ''), ' ', chr(10)), '\r\n?|\n'), lambda x: x <> '')) AS n_typed, round_even(syllables * 10 / 4, 0)::INT AS half FROM review_queue""")
def fun_escapes(spark, sf_dir):
    w = F.col("wak")
    return table(spark, sf_dir, "review_queue").select("queue_id", X.html_escaped("flag").alias("escaped"), F.left(w, F.lit(10)).alias("preview"), X.find_from(w, "ก", 3).alias("next_k"), F.size(X.lines_of_editor(F.replace(F.coalesce("guess", F.lit("")), F.lit(" "), F.lit("\n")))).alias("n_typed"), F.bround(F.col("syllables") * 10 / 4).cast("int").alias("half"))


@query()
def agg_syllable_sources(spark, sf_dir):
    """Lines of the review queue: words of the first dictionary override, the rest is cut by the syllables of all."""
    entries = table(spark, sf_dir, "override_entry").where("size(syllables) > 0")
    known = segment.dictionary_of(entries.where("dict_name = 'poetry_overrides'"))
    all_ = segment.dictionary_of(entries.select(F.explode("syllables").alias("word")).where("word <> ''").select("word", F.array("word").alias("syllables")))
    parts = segment.sourced_parts(spark, known, lambda k: segment.with_overrides(k, segment.longest_match(all_), segment.longest_match(all_)))
    q = table(spark, sf_dir, "review_queue").where("wak <> ''").select("chapter", F.explode(parts(F.col("wak"))).alias("p"))
    return q.groupBy("chapter", "p.source").agg(F.count("*").alias("n_syllables"))


def rhymes_by_class(a: Column, b: Column) -> Column:
    """Whether two syllables have one rhyme key."""
    from wakloom.functions.phonology import classes

    return F.coalesce(classes(a)["rhyme"] == classes(b)["rhyme"], F.lit(False))
