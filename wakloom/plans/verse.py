"""Queries of the verse operators over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakloom.functions import text as X
from wakloom.functions.phonology import classes, syllable_classes
from wakloom.operators import augment, dictionary, meter, metrics, rhymes, segment, structure
from wakloom.operators.memo import once_per_value
from wakloom.operators.ranking import rank_in_group
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


def lines_of(spark, sf_dir):
    chapters = table(spark, sf_dir, "documents").where("form = 'chapter' and text is not null")
    return structure.chapter_lines(chapters, "doc_id", "text")


# Lines with their anchors, as the SQL below all needs them.
_EDGE = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
LINES_SQL = (
    r"""WITH cell AS (SELECT doc_id AS chapter, unnest(regexp_split_to_array(text, '[\t\r\n]+')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\t\r\n]+'), 1) AS cell
  FROM documents WHERE form = 'chapter' AND text IS NOT NULL),
part AS (SELECT chapter, cell, contains(raw, '๏') AS anchor, regexp_replace(regexp_replace(raw, '[๏ฯ]', '', 'g'), '^EDGE+|EDGE+$', '', 'g') AS line FROM cell),
seen AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY chapter ORDER BY cell) AS n FROM part),
line AS (SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY cell) - 1 AS pos, line, n > coalesce(lag(n) OVER (PARTITION BY chapter ORDER BY cell), 0) AS anchor
  FROM seen WHERE regexp_matches(line, '[ก-ฮ]')),
run AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY chapter ORDER BY pos) AS r FROM line),
sect0 AS (SELECT *, CASE WHEN max(anchor::INT) OVER (PARTITION BY chapter) = 1 THEN r - min(r) OVER (PARTITION BY chapter) END AS section FROM run),
sect AS (SELECT *, row_number() OVER (PARTITION BY chapter, section ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY chapter, section) AS size FROM sect0)
"""
).replace("EDGE", _EDGE)


@query(LINES_SQL + "SELECT chapter, pos, line, anchor FROM line")
def src_chapter_lines(spark, sf_dir):
    return lines_of(spark, sf_dir)


@query(LINES_SQL + "SELECT chapter, section, min(pos) AS start, count(*) AS n_lines, count(*) % 4 = 0 AS whole FROM sect WHERE section IS NOT NULL GROUP BY chapter, section")
def win_sections(spark, sf_dir):
    return structure.section_sizes(lines_of(spark, sf_dir))


@query(LINES_SQL + """, body AS (SELECT *, place - size % 4 AS k FROM sect WHERE section IS NOT NULL AND size % 4 IN (0, 3) AND place >= size % 4)
SELECT chapter, section, (k // 4)::INT AS stanza, max(line) FILTER (k % 4 = 0) AS w1, max(line) FILTER (k % 4 = 1) AS w2, max(line) FILTER (k % 4 = 2) AS w3, max(line) FILTER (k % 4 = 3) AS w4
FROM body GROUP BY chapter, section, k // 4 HAVING count(*) = 4""")  # fmt: skip
def win_training_stanzas(spark, sf_dir):
    return structure.stanzas_in_sections(lines_of(spark, sf_dir))


@query(LINES_SQL + """, c AS (SELECT *, max(CASE WHEN section = 0 AND size % 4 = 3 THEN 3 ELSE 0 END) OVER (PARTITION BY chapter) AS cut FROM sect), body AS (SELECT *, pos - cut AS k FROM c WHERE pos >= cut)
SELECT chapter, (k // 4)::INT AS stanza, max(line) FILTER (k % 4 = 0) AS w1, max(line) FILTER (k % 4 = 1) AS w2, max(line) FILTER (k % 4 = 2) AS w3, max(line) FILTER (k % 4 = 3) AS w4
FROM body GROUP BY chapter, k // 4 HAVING count(*) = 4""")  # fmt: skip
def win_eval_stanzas(spark, sf_dir):
    return structure.stanzas_of_chapters(lines_of(spark, sf_dir))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY "row", stanza_id) AS pos, w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL AND w4 IS NOT NULL AND prev_w4 IS NOT NULL AS sound FROM stanza),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY chapter ORDER BY pos) AS run FROM o WHERE sound),
n AS (SELECT chapter, "row", stanza_id, w1, w2, w3, w4, lead(w1) OVER w AS v1, lead(w2) OVER w AS v2, lead(w3) OVER w AS v3, lead(w4) OVER w AS v4 FROM r WINDOW w AS (PARTITION BY chapter, run ORDER BY pos))
SELECT chapter, "row", stanza_id, concat_ws('|', w1, w2, w3, w4, v1, v2, v3, v4) AS lines FROM n WHERE v1 IS NOT NULL""")  # fmt: skip
def win_pairs_in_sound_runs(spark, sf_dir):
    st = table(spark, sf_dir, "stanza").select("chapter", "row", "stanza_id", "w1", "w2", "w3", "w4", "prev_w4")
    sound = F.col("w1").isNotNull() & F.col("w2").isNotNull() & F.col("w3").isNotNull() & F.col("w4").isNotNull() & F.col("prev_w4").isNotNull()
    out = structure.sound_windows(st, ["chapter"], ["row", "stanza_id"], sound, ["w1", "w2", "w3", "w4"])
    return out.select("chapter", "row", "stanza_id", F.concat_ws("|", *[F.col("v")[i][f"w{j}"] for i in (0, 1) for j in (1, 2, 3, 4)]).alias("lines"))


@query("""SELECT stanza_id, prev_w4 AS told, lag(w4) OVER (PARTITION BY story, chapter ORDER BY "row", stanza_id) AS before FROM stanza""")
def join_previous_row(spark, sf_dir):
    st = structure.with_previous(table(spark, sf_dir, "stanza").select("stanza_id", "story", "chapter", "row", "w4", "prev_w4"), ["story", "chapter"], ["row", "stanza_id"], "w4", "before")
    return st.select("stanza_id", F.col("prev_w4").alias("told"), "before")


@query("""WITH e AS (SELECT story, chapter, arg_max(w4, ("row", stanza_id)) AS last_w4, arg_min(w2, ("row", stanza_id)) AS first_w2, TRY_CAST(regexp_extract(chapter, '([0-9]+)', 1) AS INT) AS number FROM stanza WHERE w4 IS NOT NULL AND w2 IS NOT NULL GROUP BY story, chapter),
n AS (SELECT *, lead(chapter) OVER w AS next_chapter, lead(first_w2) OVER w AS next_w2 FROM e WINDOW w AS (PARTITION BY story ORDER BY number NULLS FIRST, chapter))
SELECT story, chapter, number, last_w4, next_chapter, next_w2 FROM n WHERE next_chapter IS NOT NULL""")  # fmt: skip
def join_chapter_seams(spark, sf_dir):
    st = table(spark, sf_dir, "stanza").where("w4 is not null and w2 is not null")
    return structure.chapter_bounds(st, X.number_in("chapter"))


_SYLL = "WITH s AS (SELECT entry_id, dict_name, word, unnest(syllables) AS syllable FROM override_entry)"


@query(_SYLL + """, d AS (SELECT DISTINCT syllable FROM s WHERE syllable <> '')
SELECT syllable, translate(syllable, '่้๊๋', '') AS bare, CASE WHEN contains(syllable, '่') AND NOT contains(syllable, '้') THEN 'aek' WHEN contains(syllable, '้') AND NOT contains(syllable, '่') THEN 'too' END AS tone FROM d""")  # fmt: skip
def pho_tones(spark, sf_dir):
    s = table(spark, sf_dir, "override_entry").select(F.explode("syllables").alias("syllable")).where("syllable <> ''").distinct()
    return syllable_classes(s, "syllable").select("syllable", X.without_tones("syllable").alias("bare"), "tone")


@query()
def pho_rhyme_classes(spark, sf_dir):
    s = table(spark, sf_dir, "override_entry").select("entry_id", F.explode("syllables").alias("syllable")).where("syllable <> ''")
    known = once_per_value(s, "syllable", syllable_classes)
    return known.groupBy("rhyme", "vowel", "final_class", "weight").agg(F.count("*").alias("n_syllables"), F.countDistinct("syllable").alias("n_distinct"))


_KEY = "\x01"  # stands before a rhyme key among parts of a line that are not in the dictionary


def syllable_keys(entries: DataFrame) -> dict[str, list[str]]:
    """Marked rhyme keys of all syllables of the entries, and of the words spelled otherwise than their syllables."""
    s = entries.select(F.explode("syllables").alias("word")).where("word <> ''").distinct()
    segment.refuse_larger(s)
    t = s.select("word", classes(F.col("word"))["rhyme"].alias("k")).toArrow()  # classes once a syllable
    own = {w: [_KEY + k] for w, k in zip(t.column("word").to_pylist(), t.column("k").to_pylist(), strict=True)}
    odd = segment.dictionary_of(entries.where("word <> '' and array_join(syllables, '') <> word"))
    return {w: [k for x in parts if x for k in own[x]] for w, parts in odd.items() if any(parts)} | own


def stanza_verdicts(st: DataFrame, entries: DataFrame) -> DataFrame:
    """stanza_id, story, edition with the verdicts on the keys of all syllables.

    Lines are cut where they stand, each distinct one of a batch once: a table
    of all distinct lines would be shuffled more than once.
    """
    bare = lambda n: F.regexp_replace(n, f"^{_EDGE}+|{_EDGE}+$", "")
    parts = segment.parts_of(st.sparkSession, syllable_keys(entries), segment.composed)
    cut = st.select("stanza_id", "story", "edition", *[parts(bare(n)).alias(n) for n in ("w1", "w2", "w3", "w4", "prev_w4")])
    key = lambda p: F.when(p.startswith(_KEY), F.substr(p, F.lit(2))).otherwise(classes(p)["rhyme"])
    keys = [F.coalesce(F.transform(n, key), F.array().cast("array<string>")).alias(n) for n in ("w1", "w2", "w3", "w4")]
    arrays = cut.select("stanza_id", "story", "edition", *keys, rhymes.last(F.transform("prev_w4", key)).alias("prev_w4"))
    return rhymes.verdicts(arrays, "w1", "w2", "w3", "w4", "prev_w4")


@query()
def rule_stanza_verdicts(spark, sf_dir):
    """Lines are cut into the syllables of the dictionary entries; see the README on segmenters."""
    checked = stanza_verdicts(table(spark, sf_dir, "stanza"), table(spark, sf_dir, "override_entry"))
    return rhymes.by_rule(checked, ["stanza_id", "story"]).groupBy("story", "rule").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query("""WITH q AS (SELECT flag IS NOT NULL AND flag <> '' AS gold, CASE WHEN syllables IS NULL THEN NULL ELSE syllables NOT BETWEEN 8 AND 9 END AS pred, chapter FROM review_queue),
c AS (SELECT chapter, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp, count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn, count(*) FILTER (gold IS NOT NULL AND pred IS NULL) AS dropped FROM q GROUP BY ROLLUP (chapter)),
m AS (SELECT *, tp + fp + fn + tn AS seen, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c)
SELECT chapter, tp, fp, fn, tn, dropped, precision, recall, CASE WHEN seen + dropped > 0 THEN round(seen / (seen + dropped), 6) END AS coverage, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM m""")  # fmt: skip
def agg_confusion_rollup(spark, sf_dir):
    q = table(spark, sf_dir, "review_queue").select("chapter", (F.col("flag").isNotNull() & (F.col("flag") != "")).alias("gold"), (~F.col("syllables").between(8, 9)).alias("pred"))
    counts = q.rollup("chapter").agg(*metrics.confusion("gold", "pred"))
    return metrics.with_metrics(counts).select("chapter", "tp", "fp", "fn", "tn", "dropped", "precision", "recall", "coverage", "f1")


@query("""SELECT chapter, count(*) AS n, count(*) FILTER (syllables <= 6) AS openers, count(*) FILTER (syllables BETWEEN 7 AND 9) AS bodies, count(*) FILTER (syllables >= 10) AS irregular,
coalesce(round(avg((flag IS NOT NULL AND flag <> '')::INT), 6), 0) AS flag_rate FROM review_queue GROUP BY chapter""")
def agg_line_kinds(spark, sf_dir):
    n = F.col("syllables")
    flagged = (F.col("flag").isNotNull() & (F.col("flag") != "")).cast("int")
    return table(spark, sf_dir, "review_queue").groupBy("chapter").agg(F.count("*").alias("n"), F.count_if(n <= 6).alias("openers"), F.count_if(n.between(7, 9)).alias("bodies"), F.count_if(n >= 10).alias("irregular"), F.coalesce(F.round(F.avg(flagged), 6), F.lit(0.0)).alias("flag_rate"))


@query("SELECT story, edition, count(*) AS n_stanzas, 4 * count(*) AS n_lines, count(DISTINCT chapter) AS n_chapters, count(prev_w4) AS n_links FROM stanza GROUP BY GROUPING SETS ((story, edition), (story), ())")
def agg_story_totals(spark, sf_dir):
    """Three small groupings over one pre-aggregation to chapters instead of an expand of all rows."""
    part = table(spark, sf_dir, "stanza").groupBy("story", "edition", "chapter").agg(F.count("*").alias("n"), F.count("prev_w4").alias("links"))
    spread = part.groupingSets([[F.col("story"), F.col("edition")], [F.col("story")], []], "story", "edition")
    return spread.agg(F.sum("n").alias("n_stanzas"), (4 * F.sum("n")).alias("n_lines"), F.countDistinct("chapter").alias("n_chapters"), F.sum("links").alias("n_links"))


@query("""SELECT mark, sum(n) AS n FROM (SELECT unnest(string_split(flag, '; ')) AS mark, 1 AS n FROM review_queue WHERE flag <> '') GROUP BY mark""")
def agg_flag_parts(spark, sf_dir):
    return table(spark, sf_dir, "review_queue").where("flag <> ''").select(F.explode(F.split("flag", "; ")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))


@query("""SELECT edition, count(*) FILTER ("row" % 4 = 0) AS q0, count(*) FILTER ("row" % 4 = 1) AS q1, count(*) FILTER ("row" % 4 = 2) AS q2, count(*) FILTER ("row" % 4 = 3) AS q3 FROM stanza GROUP BY edition""")
def agg_pivot(spark, sf_dir):
    st = table(spark, sf_dir, "stanza").select("edition", F.concat(F.lit("q"), F.pmod("row", F.lit(4))).alias("q"))
    return st.groupBy("edition").pivot("q", ["q0", "q1", "q2", "q3"]).agg(F.count(F.lit(1))).na.fill(0)


@query(_SYLL + ", f AS (SELECT syllable, count(*) AS freq, min(entry_id) AS first_id FROM s WHERE syllable <> '' GROUP BY syllable) SELECT f.*, arg_min(word, s.entry_id) AS first_word FROM f JOIN s ON s.syllable = f.syllable AND s.entry_id = f.first_id GROUP BY ALL")
def agg_syllable_frequency(spark, sf_dir):
    s = table(spark, sf_dir, "override_entry").select("entry_id", "word", F.explode("syllables").alias("syllable")).where("syllable <> ''")
    return s.groupBy("syllable").agg(F.count("*").alias("freq"), F.min("entry_id").alias("first_id"), F.min_by("word", "entry_id").alias("first_word"))


@query(_SYLL + """, f AS (SELECT syllable, count(*) AS freq FROM s WHERE syllable <> '' GROUP BY syllable)
SELECT least_n, count(*) AS n_terms, sum(freq)::BIGINT AS n_occurrences FROM f JOIN (VALUES (1), (2), (3), (5), (10)) t(least_n) ON freq >= least_n GROUP BY least_n""")
def join_thresholds(spark, sf_dir):
    """The five thresholds go to the terms as an array: no join and no product of the rows."""
    s = table(spark, sf_dir, "override_entry").select(F.explode("syllables").alias("syllable")).where("syllable <> ''")
    f = s.groupBy("syllable").agg(F.count("*").alias("freq"))
    steps = F.array(*[F.lit(n) for n in (1, 2, 3, 5, 10)])
    return f.select("freq", F.explode(F.filter(steps, lambda n: n <= F.col("freq"))).alias("least_n")).groupBy("least_n").agg(F.count("*").alias("n_terms"), F.sum("freq").alias("n_occurrences"))


@query("""WITH m AS (SELECT DISTINCT word_id, ipa FROM overrides_main), s AS (SELECT DISTINCT word_id, ipa FROM overrides_space)
SELECT coalesce(m.word_id, s.word_id) AS word_id, CASE WHEN s.word_id IS NULL THEN m.ipa ELSE s.ipa END AS ipa,
CASE WHEN m.word_id IS NULL THEN 'insert' WHEN s.word_id IS NULL THEN 'keep' WHEN m.ipa IS NOT DISTINCT FROM s.ipa THEN 'same' ELSE 'update' END AS action FROM m FULL JOIN s ON m.word_id = s.word_id""")  # fmt: skip
def join_merge_actions(spark, sf_dir):
    m, s = (table(spark, sf_dir, f"overrides_{x}").select("word_id", "ipa").distinct() for x in ("main", "space"))
    return dictionary.merge_actions(m, s, "word_id", "ipa")


@query("""WITH a AS (SELECT word, min(n_seen) AS n FROM overrides_main GROUP BY word), x AS (SELECT *, 0 AS layer FROM a UNION ALL SELECT word, min(n_seen), 1 FROM overrides_space GROUP BY word UNION ALL SELECT word, min(n_seen), 2 FROM override_draft GROUP BY word),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY layer) AS k FROM x) SELECT word, n, layer FROM r WHERE k = 1""")  # fmt: skip
def set_layers(spark, sf_dir):
    layers = [table(spark, sf_dir, t).groupBy("word").agg(F.min("n_seen").alias("n")) for t in ("overrides_main", "overrides_space", "override_draft")]
    return dictionary.layered(layers, "word")


@query("""SELECT DISTINCT word FROM override_entry WHERE word NOT IN (SELECT word FROM override_draft WHERE word IS NOT NULL) AND word NOT IN (SELECT word FROM overrides_main WHERE word IS NOT NULL)""")
def set_uncovered(spark, sf_dir):
    words = table(spark, sf_dir, "override_entry").select("word").where("word is not null").distinct()
    return words.join(table(spark, sf_dir, "override_draft").select("word"), "word", "left_anti").join(table(spark, sf_dir, "overrides_main").select("word"), "word", "left_anti")


@query("""WITH b AS (SELECT word FROM overrides_main UNION SELECT word FROM override_draft), x AS (SELECT * FROM b EXCEPT SELECT word FROM overrides_space) SELECT word FROM x""")
def set_union_less_block(spark, sf_dir):
    words = lambda t: table(spark, sf_dir, t).select("word")
    return words("overrides_main").union(words("override_draft")).distinct().subtract(words("overrides_space"))


@query("""WITH a AS (SELECT chapter, wak, arg_min(a, queue_id) AS a FROM review_queue WHERE a IS NOT NULL AND a <> '' AND wak IS NOT NULL GROUP BY chapter, wak) SELECT q.queue_id, coalesce(a.a, q.guess) AS guess FROM review_queue q LEFT JOIN a USING (chapter, wak)""")
def join_review_overlay(spark, sf_dir):
    q = table(spark, sf_dir, "review_queue")
    answers = q.where("a is not null and a <> '' and wak is not null").groupBy("chapter", "wak").agg(F.min_by("a", "queue_id").alias("a"))
    return dictionary.overlay(q.select("queue_id", "chapter", "wak", "guess"), answers, ["chapter", "wak"], "guess", "a").select("queue_id", "guess")


@query("""WITH q AS (SELECT chapter, wak, min(queue_id) AS first_id, count(*) AS n FROM review_queue WHERE wak <> '' GROUP BY chapter, wak) SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM review_queue r WHERE r.chapter = q.chapter AND r.wak = q.wak AND r.a <> '')""")
def join_open_queue(spark, sf_dir):
    q = table(spark, sf_dir, "review_queue").where("wak <> ''")
    answered = q.where("a <> ''").select("chapter", "wak")
    return q.groupBy("chapter", "wak").agg(F.min("queue_id").alias("first_id"), F.count("*").alias("n")).join(answered, ["chapter", "wak"], "left_anti")


@query("""WITH p AS (SELECT word, min(entry_id) FILTER (dict_name = 'poetry_overrides') AS a, min(entry_id) FILTER (dict_name = 'poetry_overrides_base') AS b FROM override_entry GROUP BY word),
t AS (SELECT draft_id, word, len(syllables) AS own FROM override_draft) SELECT t.draft_id, coalesce(p.a, p.b, -1) AS source_id, CASE WHEN p.a IS NOT NULL THEN 'main' WHEN p.b IS NOT NULL THEN 'base' WHEN own > 0 THEN 'own' ELSE 'none' END AS origin FROM t LEFT JOIN p USING (word)""")  # fmt: skip
def join_priority_chain(spark, sf_dir):
    e = table(spark, sf_dir, "override_entry")
    pick = lambda name: F.min(F.when(F.col("dict_name") == name, F.col("entry_id")))
    known = e.groupBy("word").agg(pick("poetry_overrides").alias("a"), pick("poetry_overrides_base").alias("b"))
    d = table(spark, sf_dir, "override_draft").join(known, "word", "left")
    origin = F.when(F.col("a").isNotNull(), "main").when(F.col("b").isNotNull(), "base").when(F.size("syllables") > 0, "own").otherwise("none")
    return d.select("draft_id", F.coalesce("a", "b", F.lit(-1).cast("long")).alias("source_id"), origin.alias("origin"))


@query("""SELECT a.edition AS edition, count(*) AS n_pairs FROM (SELECT DISTINCT edition, w1 FROM eval_row) a JOIN (SELECT DISTINCT w1, edition AS other FROM stanza) b ON a.w1 = b.w1 WHERE a.edition <> b.other GROUP BY a.edition""")
def join_class_unlike(spark, sf_dir):
    a = table(spark, sf_dir, "eval_row").select("edition", "w1").distinct()
    b = table(spark, sf_dir, "stanza").select("w1", F.col("edition").alias("other")).distinct()
    return a.join(b, "w1").where("edition <> other").groupBy("edition").agg(F.count("*").alias("n_pairs"))


@query("""SELECT queue_id, wak, row_number() OVER (PARTITION BY chapter, wak ORDER BY queued_at, queue_id) AS k FROM review_queue WHERE wak <> '' QUALIFY k <= 2""")
def win_quota(spark, sf_dir):
    w = Window.partitionBy("chapter", "wak").orderBy("queued_at", "queue_id")
    return table(spark, sf_dir, "review_queue").where("wak <> ''").withColumn("k", F.row_number().over(w)).where("k <= 2").select("queue_id", "wak", "k")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY line_no, entry_id) AS k FROM override_entry) SELECT entry_id, word, dict_name FROM r WHERE k = 1""")
def win_first_occurrence(spark, sf_dir):
    e = table(spark, sf_dir, "override_entry").select("entry_id", "word", "dict_name", "line_no")
    return dictionary.best_per_key(e, ["word"], F.struct("line_no", "entry_id")).select("entry_id", "word", "dict_name")


@query("""SELECT chapter, "row", 'neg_' || lpad(row_number() OVER (PARTITION BY chapter ORDER BY "row", stanza_id)::VARCHAR, 6, '0') AS label, story || '#' || chapter || ':' || "row" AS place, ntile(4) OVER (PARTITION BY chapter ORDER BY "row", stanza_id) AS slice FROM stanza""")
def win_numbering(spark, sf_dir):
    st = table(spark, sf_dir, "stanza").select("story", "chapter", "row", "stanza_id")
    placed = rank_in_group(st, ["chapter"], ["row", "stanza_id"], "k")
    n = st.groupBy("chapter").agg(F.count("*").alias("n"))
    placed = placed.join(n, "chapter")
    # Of n rows in four slices, the first n mod 4 slices have one more.
    small, more = F.floor(F.col("n") / 4), F.col("n") % 4
    early = (small + 1) * more
    slice_ = F.when(F.col("k") < early, F.floor(F.col("k") / (small + 1))).otherwise(more + F.floor((F.col("k") - early) / F.greatest(small, F.lit(1)))) + 1
    return placed.select("chapter", "row", F.concat(F.lit("neg_"), F.lpad((F.col("k") + 1).cast("string"), 6, "0")).alias("label"), F.concat_ws("", "story", F.lit("#"), "chapter", F.lit(":"), F.col("row").cast("string")).alias("place"), slice_.alias("slice"))


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY n_seen DESC NULLS LAST, word_id) - 1 AS r FROM (SELECT DISTINCT word_id, n_seen, reviewed FROM overrides_main) WHERE reviewed), b AS (SELECT *, row_number() OVER (ORDER BY n_seen DESC NULLS LAST, word_id) - 1 AS r FROM (SELECT DISTINCT word_id, n_seen, reviewed FROM overrides_main) WHERE NOT reviewed)
SELECT word_id, r + r // 3 AS slot FROM a UNION ALL SELECT word_id, 4 * r + 3 FROM b""")  # fmt: skip
def win_interleave(spark, sf_dir):
    m = table(spark, sf_dir, "overrides_main").select("word_id", "n_seen", "reviewed").distinct()
    return dictionary.interleave(m.where("reviewed"), m.where("not reviewed"), [F.col("n_seen").desc_nulls_last(), F.col("word_id")]).select("word_id", "slot")


@query("""SELECT syllable, freq FROM (SELECT syllable, count(*) AS freq FROM (SELECT unnest(syllables) AS syllable FROM override_draft) WHERE syllable <> '' GROUP BY syllable) ORDER BY freq DESC, encode(syllable) LIMIT 60""")
def ord_top_terms(spark, sf_dir):
    s = table(spark, sf_dir, "override_draft").select(F.explode("syllables").alias("syllable")).where("syllable <> ''")
    return s.groupBy("syllable").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "syllable").limit(60)


@query("""SELECT chapter, row_number() OVER (PARTITION BY regexp_replace(chapter, '_[0-9]+$', '') ORDER BY TRY_CAST(regexp_extract(chapter, '([0-9]+)', 1) AS INT) NULLS FIRST, chapter) AS place, regexp_replace(chapter, '_[0-9]+$', '') AS work FROM (SELECT DISTINCT chapter FROM stanza)""")
def ord_numeric_chapters(spark, sf_dir):
    c = table(spark, sf_dir, "stanza").select("chapter").distinct().withColumn("work", X.work_of("chapter"))
    return c.select("chapter", F.row_number().over(Window.partitionBy("work").orderBy(X.number_in("chapter"), "chapter")).alias("place"), "work")


@query(r"""SELECT queue_id, regexp_replace(wak, '[^ก-ฮ่้๊๋ะาิีึืุูเแโใไัำ็์ฺๅๆ]', '', 'g') AS letters, length(wak) AS n, right(wak, 1) AS tail, CASE WHEN wak LIKE '%วั่น' THEN left(wak, length(wak) - 4) || 'X' ELSE wak END AS swapped,
CASE WHEN instr(wak, 'วั่น') > 0 THEN substr(wak, greatest(1, instr(wak, 'วั่น') - 8), instr(wak, 'วั่น') - greatest(1, instr(wak, 'วั่น') - 8) + 14) END AS around, regexp_matches(wak, '[ก-ฮ]') AS thai FROM review_queue""")
def fun_strings(spark, sf_dir):
    w = F.col("wak")
    return table(spark, sf_dir, "review_queue").select("queue_id", X.clean_letters("wak").alias("letters"), F.length(w).alias("n"), F.right(w, F.lit(1)).alias("tail"), X.replace_suffix(w, F.lit("วั่น"), F.lit("X")).alias("swapped"), X.context(w, F.lit("วั่น")).alias("around"), X.has_consonant(w).alias("thai"))


@query("""SELECT entry_id, len(syllables) AS n, array_to_string(syllables, '-') AS joined, syllables[1] AS head, syllables[-1] AS tail, list_contains(syllables, 'วั่น') AS has, array_to_string(list_sort(syllables), '|') AS sorted, array_to_string(syllables[2:4], '|') AS middle, len(list_distinct(syllables)) AS n_distinct, list_sum(list_transform(syllables, lambda x: length(x)))::BIGINT AS n_points FROM override_entry WHERE len(syllables) > 0""")
def fun_arrays(spark, sf_dir):
    s = F.col("syllables")
    n_points = F.aggregate(F.transform(s, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "override_entry").where("size(syllables) > 0").select("entry_id", F.size(s).alias("n"), F.array_join(s, "-").alias("joined"), F.try_element_at(s, F.lit(1)).alias("head"), rhymes.last(s).alias("tail"), F.array_contains(s, "วั่น").alias("has"), F.array_join(F.array_sort(s), "|").alias("sorted"), F.array_join(F.slice(s, 2, 3), "|").alias("middle"), F.size(F.array_distinct(s)).alias("n_distinct"), n_points.alias("n_points"))


@query("""WITH w AS (SELECT DISTINCT word FROM override_entry WHERE word IS NOT NULL) SELECT word, regexp_matches(word, '[ก-ฮ][รล]') AS cluster, regexp_matches(word, '[ฤฦ]') AS rare_vowel, regexp_matches(word, '[ก-ฮ][่-๋]?์$') AS silent_end, regexp_matches(word, 'ำ[ก-ฮ]$|[ก-ฮ][ใไ]ย$|เ[ก-ฮ]าว$') AS double_final FROM w""")
def fun_spelling_flags(spark, sf_dir):
    w = table(spark, sf_dir, "override_entry").select("word").where("word is not null").distinct()
    flags = X.spelling_flags("word")
    return w.select("word", *[F.array_contains(flags, f).alias(f) for f in ("cluster", "rare_vowel", "silent_end", "double_final")])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k, round(value * 100 / 7, 4) AS scaled FROM events""")
def fun_json_numbers(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNotNull().alias("has_k"), F.round(F.col("value") * 100 / 7, 4).alias("scaled"))


@query(_SYLL + """, n AS (SELECT entry_id, len(syllables) AS n FROM override_entry) SELECT entry_id, coalesce(n, 0) AS n_syllables, CASE WHEN coalesce(n, 0) <= 6 THEN 'opener' WHEN n <= 9 THEN 'body' ELSE 'irregular' END AS kind,
CASE n WHEN 7 THEN '3,2,2' WHEN 8 THEN '3,2,3' WHEN 9 THEN '3,3,3' END AS rhythm, coalesce(n = 7 OR n >= 10, false) AS needs_review FROM n""")
def rule_line_analysis(spark, sf_dir):
    """Each syllable of an entry is a word of its own."""
    e = table(spark, sf_dir, "override_entry").select("entry_id", F.transform("syllables", lambda s: F.struct(s.alias("w"), F.lit(1).alias("n"))).alias("words"))
    out = meter.analysed(e, "words")
    return out.select("entry_id", "n_syllables", "kind", F.array_join(F.transform("rhythm", lambda x: x.cast("string")), ",").alias("rhythm"), "needs_review")


_BLANK = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


@query("WITH q AS (SELECT queue_id, " + ", ".join(f"regexp_replace(coalesce({c}, ''), '{_BLANK}', '', 'g') AS {c}" for c in ("wak", "a", "b", "c")) + """ FROM review_queue)
SELECT queue_id, CASE WHEN a || b || c = '' THEN 'deferred' WHEN lower(a) = 'x' AND b || c = '' THEN 'exclude' WHEN a <> '' AND b <> '' AND c <> '' AND a || b || c = wak THEN 'cut' ELSE 'rejected' END AS action FROM q""")
def rule_manual_cuts(spark, sf_dir):
    return table(spark, sf_dir, "review_queue").select("queue_id", meter.manual_cut(F.col("wak"), F.col("a"), F.col("b"), F.col("c")).alias("action"))


def _classes(spark, sf_dir):
    s = table(spark, sf_dir, "override_entry").select(F.explode("syllables").alias("syll")).where("syll <> ''").distinct()
    return syllable_classes(s, "syll")


@query()
def aug_class_pairs(spark, sf_dir):
    return augment.class_pairs(_classes(spark, sf_dir), 60)


@query()
def aug_candidates(spark, sf_dir):
    classes = _classes(spark, sf_dir)
    return augment.candidates(classes, "same_final").unionAll(augment.candidates(classes, "same_vowel")).unionAll(augment.candidates(classes, "swapped"))


@query()
def udf_longest_match(spark, sf_dir):
    """Lines of the review queue cut to the syllables of the dictionary."""
    known = segment.dictionary_of(table(spark, sf_dir, "override_entry"))
    q = table(spark, sf_dir, "review_queue").select("queue_id", "wak")
    return segment.segmented(q, "wak", known).select("queue_id", "wak", F.size("parts").alias("n_parts"), F.array_join("parts", "-").alias("parts"))


@query()
def udf_fewest_syllables(spark, sf_dir):
    known = segment.dictionary_of(table(spark, sf_dir, "override_draft"))
    words = table(spark, sf_dir, "override_entry").select("word").where("word is not null").distinct()
    return segment.segmented(words, "word", known, segment.fewest_syllables).select("word", F.array_join("parts", "-").alias("parts"))


@query(r"""WITH g AS (SELECT queue_id, regexp_split_to_array(guess, '\s*\|\s*') AS p FROM review_queue) SELECT queue_id, CASE WHEN p IS NOT NULL THEN coalesce(p[1], '') END AS a, CASE WHEN p IS NOT NULL THEN coalesce(p[2], '') END AS b, CASE WHEN p IS NOT NULL THEN coalesce(p[3], '') END AS c FROM g""")
def snk_beat_cells(spark, sf_dir):
    cells = structure.beat_cells(F.col("guess"))
    return table(spark, sf_dir, "review_queue").select("queue_id", *[cells[i].alias("abc"[i]) for i in range(3)])


@query("""WITH l AS (SELECT stanza_id, story, chapter, "row", w1, w2, w3, w4 FROM stanza), p AS (SELECT a.stanza_id, a.chapter, a."row", [a.w1, a.w2, a.w3, a.w4, b.w1, b.w2, b.w3, b.w4] AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY "row", stanza_id) AS k FROM l) a JOIN (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY "row", stanza_id) AS k FROM l) b ON a.chapter = b.chapter AND b.k = a.k + 1)
SELECT stanza_id, chapter, len(list_filter(w, lambda x: x IS NULL)) AS n_missing, len(list_distinct(w)) AS n_distinct FROM p""")  # fmt: skip
def join_next_row_units(spark, sf_dir):
    """Units of eight lines: each stanza with the next of its chapter."""
    st = table(spark, sf_dir, "stanza").select("stanza_id", "chapter", "row", "w1", "w2", "w3", "w4")
    units = structure.sound_windows(st, ["chapter"], ["row", "stanza_id"], F.lit(True), ["w1", "w2", "w3", "w4"])
    lines = F.array(*[F.col("v")[i][f"w{j}"] for i in (0, 1) for j in (1, 2, 3, 4)])
    return units.select("stanza_id", "chapter", F.size(F.filter(lines, lambda x: x.isNull())).alias("n_missing"), F.size(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))).alias("n_distinct"))


@query("""WITH m AS (SELECT source, form, count(*) AS n FROM documents WHERE source IS NOT NULL AND form IS NOT NULL GROUP BY ALL) SELECT source, max(n) FILTER (form = 'chapter') AS chapters, coalesce(max(n) FILTER (form = 'note'), 0) AS notes, count(*) AS n_forms FROM m GROUP BY source""")
def fun_maps(spark, sf_dir):
    """Forms are few, so a source's map is small."""
    d = table(spark, sf_dir, "documents").select("source", "form").where("source is not null and form is not null").groupBy("source", "form").agg(F.count("*").alias("n"))
    m = d.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("form", "n"))).alias("m"))
    return m.select("source", F.try_element_at("m", F.lit("chapter")).alias("chapters"), F.coalesce(F.try_element_at("m", F.lit("note")), F.lit(0).cast("long")).alias("notes"), F.size("m").alias("n_forms"))


@query("""SELECT queue_id, TRY_CAST(nullif(regexp_extract(flag, '([0-9]+) syllables', 1), '') AS INT) AS told, contains(flag, 'lone consonant') AS lone, CASE WHEN flag IS NULL OR flag = '' THEN 'none' WHEN contains(flag, 'runs over') THEN 'straddle' WHEN contains(flag, 'lone') THEN 'lone' ELSE 'other' END AS sort FROM review_queue""")
def fun_parsed_messages(spark, sf_dir):
    f = F.col("flag")
    sort = F.when(f.isNull() | (f == ""), "none").when(f.contains("runs over"), "straddle").when(f.contains("lone"), "lone").otherwise("other")
    return table(spark, sf_dir, "review_queue").select("queue_id", F.regexp_extract(f, "([0-9]+) syllables", 1).try_cast("int").alias("told"), f.contains("lone consonant").alias("lone"), sort.alias("sort"))


@query("""WITH q AS (SELECT *, sha256(coalesce('+' || wak, '-')) AS h FROM review_queue) SELECT flag, count(*) AS n, count(DISTINCT h) AS n_lines, min(queued_at) AS since FROM q WHERE queued_at < loaded_at GROUP BY flag HAVING count(*) >= 3""")
def agg_having(spark, sf_dir):
    q = table(spark, sf_dir, "review_queue").where("queued_at < loaded_at").withColumn("h", F.sha2(F.coalesce(F.concat(F.lit("+"), "wak"), F.lit("-")), 256))
    return q.groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_lines"), F.min("queued_at").alias("since")).where("n >= 3")
