"""Building a pronunciation dictionary: screening of entries, fixes, buckets, coverage, clean candidates.

Entries have word and syllables; spelled is another division of the same word
(by letters), which syllables are held against place by place. All is column
expressions, so a table of any size is screened in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakloom.functions.text import TONES

VOWELS = "ะาิีึืุูเแโใไำัอ็"
# Finals written twice, with what is said of them.
DOUBLE_FINALS = {"ำ[ก-ฮ]$": "redundant ำ+cons", "[ก-ฮ][ใไ]ย$": "redundant ไ/ใ+ย", "เ[ก-ฮ]าว$": "redundant เ-า+ว"}


def tones_in(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{TONES}]", "")


def screening_flags(word: Column, syllables: Column, spelled: Column, rhymes, lenient: bool = False) -> Column:
    """What is to be looked at in an entry of two or more syllables; empty for others.

    rhymes(a, b): whether two syllables sound alike. lenient: a spelling of
    fewer syllables passes unless a syllable is a bare fragment.
    """
    lost, kept = F.length(tones_in(word)), F.length(tones_in(F.array_join(syllables, "")))
    at = lambda text, i, o=None: F.concat(F.lit(f"{text} @"), (i + 1).cast("string"), *([] if o is None else [F.lit(" ("), o, F.lit(")")]))

    def shape(o: Column, i: Column) -> Column:
        double = [F.when(o.rlike(p), at(text, i)) for p, text in DOUBLE_FINALS.items()]
        return F.array_compact(F.array(F.when(F.length(o) < 2, at("1-char syllable", i, o)), *double))

    def sound(i: Column) -> Column:
        ws, o = F.get(spelled, i), F.get(syllables, i)
        pair = F.concat(ws, F.lit(" vs "), o)
        changed = (tones_in(ws) != "") & (tones_in(o) != "") & (tones_in(ws) != tones_in(o))
        judged = (F.length(ws) >= 2) & ~ws.contains("์")
        return F.array_compact(F.array(F.when(changed, at("tone changed", i, pair)), F.when(judged & ~rhymes(ws, o), at("sound mismatch", i, pair))))

    n, m = F.size(syllables), F.coalesce(F.size(spelled), F.lit(0))
    bare = F.exists(syllables, lambda o: (F.length(o) < 2) | ~o.rlike(f"[{VOWELS}]"))
    more = F.concat(F.lit("ssg splits more than override ("), m.cast("string"), F.lit(" vs "), n.cast("string"), F.lit(")"))
    other = F.concat(F.lit("syllable count differs (ssg "), m.cast("string"), F.lit(" vs w2p "), n.cast("string"), F.lit(")"))
    none = F.array().cast("array<string>")
    count = F.when(m > n, F.array(more)).when(F.lit(lenient) & ~bare, none).otherwise(F.array(other))
    by_place = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), sound))
    tone = F.when(kept < lost, F.array(F.concat(F.lit("tone lost "), lost.cast("string"), F.lit("→"), kept.cast("string")))).otherwise(none)
    found = F.concat(tone, F.flatten(F.transform(syllables, shape)), F.when(m == 0, none).when(m != n, count).otherwise(by_place))
    return F.when(n >= 2, found).otherwise(none)


def fixed_finals(syllables: Column, spelled: Column) -> Column:
    """(syllables, changed): the spelled form in place of one that only writes its final twice; only where both are as long."""

    def one(o: Column, i: Column) -> Column:
        ws = F.get(spelled, i)
        twice = (
            (ws.endswith("ำ") & (o == F.replace(ws, F.lit("ำ"), F.lit("าม")))) | (ws.rlike("[ไใ]$") & (o == F.concat(ws, F.lit("ย"))))
            | (ws.endswith("า") & ws.contains("เ") & (o == F.concat(ws, F.lit("ว"))))
        )
        return F.when(twice & (F.length(ws) >= 2) & ~ws.contains("์"), ws).otherwise(o)

    same = F.coalesce((F.size(syllables) >= 2) & (F.size(syllables) == F.size(spelled)), F.lit(False))
    new = F.when(same, F.transform(syllables, one)).otherwise(syllables)
    return F.struct(new.alias("syllables"), F.coalesce(new != syllables, F.lit(False)).alias("changed"))


def prefer_spelled(syllables: Column, spelled: Column, rhymes) -> Column:
    """The spelled division where every syllable of it sounds like its counterpart and none is a fragment or silenced; else null."""
    whole = F.forall(spelled, lambda w: (F.length(w) >= 2) & ~w.contains("์"))
    alike = F.forall(F.arrays_zip(spelled.alias("w"), syllables.alias("o")), lambda z: rhymes(z["w"], z["o"]))
    return F.when((F.size(spelled) > 0) & (F.size(spelled) == F.size(syllables)) & whole & alike, spelled)


def buckets(entries: DataFrame, freq: str, flags: str, changed: str, composed: str, least: int = 2) -> DataFrame:
    """entries with bucket: COMPOSED, FIXED (flagged, a fix is known), REVIEW (flagged), SKIP (rare), AUTO."""
    flagged = F.size(flags) > 0
    return entries.withColumn("bucket", F.when(F.col(composed), "COMPOSED").when(flagged & F.col(changed), "FIXED").when(flagged, "REVIEW").when(F.col(freq) < least, "SKIP").otherwise("AUTO"))


def bucket_sizes(entries: DataFrame, freq: str) -> DataFrame:
    """bucket, n_words, n_occurrences, and their share of all occurrences in per cent."""
    part = entries.groupBy("bucket").agg(F.count("*").alias("n_words"), F.sum(freq).alias("n_occurrences"))
    whole = part.agg(F.sum("n_occurrences").alias("_all"))
    return part.join(F.broadcast(whole)).withColumn("percent", F.round(100 * F.col("n_occurrences") / F.col("_all"), 2)).drop("_all")  # one row


def compose_by_rounds(words: DataFrame, known: DataFrame, compose, most: int = 20) -> DataFrame:
    """word, syllables, round: words made of known ones; what one round makes the next may use, until nothing is new.

    words: word, freq. compose(words, known): word, syllables of those that can
    be made. Rounds take the place of an order of words by frequency, in which
    a word is only made of words before it: the result does not depend on it.
    """
    from wakloom.session import settle

    left, have, out = words.select("word").join(known.select("word"), "word", "left_anti"), known.select("word", "syllables"), None
    for k in range(most):
        new = settle(compose(left, have).select("word", "syllables").withColumn("round", F.lit(k)), "composed")
        if new.isEmpty():
            break
        out = new if out is None else out.unionAll(new)
        have, left = have.unionAll(new.select("word", "syllables")), left.join(new.select("word"), "word", "left_anti")
    return out if out is not None else known.select("word", "syllables", F.lit(0).alias("round")).limit(0)


def coverage(tokens: DataFrame, token: str, known: DataFrame) -> DataFrame:
    """n_tokens, n_covered, n_left, percent, n_words, n_words_left of tokens whose word known has. Tokens are summed to words before the join."""
    per = tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("word")).agg(F.count("*").alias("n"))
    hit = per.join(known.select("word").distinct().withColumn("has", F.lit(True)), "word", "left").withColumn("has", F.col("has").isNotNull())
    covered = F.coalesce(F.sum(F.when(F.col("has"), F.col("n"))), F.lit(0))
    out = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), covered.alias("n_covered"), F.count("*").alias("n_words"), F.count_if(~F.col("has")).alias("n_words_left"))
    return out.withColumn("n_left", F.col("n_tokens") - F.col("n_covered")).withColumn("percent", F.when(F.col("n_tokens") > 0, F.round(100 * F.col("n_covered") / F.col("n_tokens"), 2)))


def clean_candidate(c: Column, most: int = 6) -> Column:
    """Thai letters only, two to most of them, no digit, ฯ, ๆ."""
    return F.coalesce(F.length(c).between(2, most) & c.rlike("^[฀-๿]+$") & ~c.rlike("[๐-๙ฯๆ]"), F.lit(False))


def clean_candidates(pool: DataFrame, syllable: str, excluded: DataFrame, allowed: DataFrame, curated: DataFrame, positive: bool = True, most: int = 6) -> DataFrame:
    """pool without what may not stand in for another syllable.

    excluded, allowed: syllable tables; an empty allowed allows all. Syllables
    in ฤ or ฦ need an entry in curated (word, syllables), for positive ones of
    a single syllable.
    """
    s = F.col(syllable)
    rue = curated.where(F.size("syllables") == 1) if positive else curated
    fine = pool.where(clean_candidate(s, most)).join(excluded.select(F.col(excluded.columns[0]).alias(syllable)), syllable, "left_anti")
    special = fine.where(s.rlike("[ฤฦ]")).join(rue.select(F.col("word").alias(syllable)), syllable, "left_semi")
    plain = fine.where(~s.rlike("[ฤฦ]"))
    if not allowed.isEmpty():
        plain = plain.join(allowed.select(F.col(allowed.columns[0]).alias(syllable)), syllable, "left_semi")
    return plain.unionByName(special)


def building_blocks(entries: DataFrame) -> DataFrame:
    """entries with part: single (a word of one letter), one_syllable, dropped."""
    return entries.withColumn("part", F.when(F.length("word") == 1, "single").when(F.size("syllables") == 1, "one_syllable").otherwise("dropped"))


def normalisation(vowel: Column, final_class: Column) -> Column:
    """N1 or N2: which merging of sounds a rhyme key of these needs; null for none."""
    return F.when((vowel == "อะ") & (final_class == "เกย"), "N1").when(vowel.isin("อะ", "อำ") & (final_class == "กม"), "N2")


def phenomena(word: Column, vowel: Column, final_class: Column, rhyme: Column) -> Column:
    """Sorted tags of what a syllable exercises: karun, rue, sara_norm, true_final."""
    glide = word.rlike("[ยว]$") & F.element_at(F.split(rhyme, " "), 1).isin("ไอ", "เอา", "อัว")
    tags = {"karun": word.contains("์"), "rue": word.rlike("[ฤฦ]"), "sara_norm": normalisation(vowel, final_class).isNotNull(), "true_final": glide}
    return F.array_compact(F.array(*[F.when(ok, F.lit(t)) for t, ok in tags.items()]))
