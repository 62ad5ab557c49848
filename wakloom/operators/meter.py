"""Beats of a line: the pattern its length asks for, where the cuts fall, cuts made by hand.

Lines come as arrays of words (w, n): a word and its syllables' number. All is
column expressions over the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakloom.functions.text import EDGE

BAR = " | "


def total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + w["n"])


def kind(n: Column) -> Column:
    """opener up to 6 syllables, body to 9, irregular beyond."""
    return F.when(n <= 6, "opener").when(n <= 9, "body").otherwise("irregular")


def pattern(words: Column) -> Column:
    """Syllables of the three beats; null where no pattern fits.

    Nine syllables with one word of four or more at an end give that end four.
    """
    n, long = total(words), F.filter(words, lambda w: w["n"] >= 4)
    at_start, at_end = F.get(words, F.lit(0))["n"] >= 4, F.try_element_at(words, F.lit(-1))["n"] >= 4
    beats = lambda *b: F.array(*[F.lit(x) for x in b])
    nine = F.when(F.size(long) == 0, beats(3, 3, 3)).when((F.size(long) == 1) & at_start, beats(4, 2, 3)).when((F.size(long) == 1) & at_end, beats(3, 2, 4))
    return F.when(n == 7, beats(3, 2, 2)).when(n == 8, beats(3, 2, 3)).when(n == 9, nine)


def ends_of(numbers: Column) -> Column:
    """Running sums of an array of numbers."""
    return F.transform(numbers, lambda _, i: F.aggregate(F.slice(numbers, 1, i + 1), F.lit(0), lambda a, x: a + x))


def placed(words: Column, beats: Column) -> Column:
    """(text, straddles): the words with bars where beats end, and whether a word runs over an end."""
    word_ends, beat_ends = ends_of(F.transform(words, lambda w: w["n"])), ends_of(beats)
    inner = F.slice(beat_ends, 1, F.size(beat_ends) - 1)
    # A word belongs to the beat in which it begins.
    beat = F.transform(words, lambda w, i: F.size(F.filter(beat_ends, lambda e: e <= F.element_at(word_ends, i + 1) - w["n"])))
    groups = F.transform(beats, lambda _, b: F.array_join(F.transform(F.filter(F.arrays_zip(words.alias("w"), beat.alias("b")), lambda z: z["b"] == b), lambda z: z["w"]["w"]), ""))
    return F.struct(F.array_join(groups, BAR).alias("text"), F.exists(inner, lambda e: ~F.array_contains(word_ends, e)).alias("straddles"))


def analysed(df: DataFrame, words: str) -> DataFrame:
    """df with n_syllables, kind, rhythm, segmented, flags and needs_review of an array of words.

    Null and empty arrays have no syllables and are openers. Lines of seven
    syllables are marked ambiguous, of nine with a long word inside irregular.
    """
    w = F.col(words)
    df = df.withColumn("n_syllables", F.coalesce(total(w), F.lit(0)))
    df = df.withColumns({"kind": kind(F.col("n_syllables")), "rhythm": pattern(w)})
    df = df.withColumn("_placed", F.when(F.col("rhythm").isNotNull(), placed(w, F.col("rhythm"))))
    flags = F.array_compact(F.array(
        F.when(F.col("_placed.straddles"), "straddle"), F.when(F.col("n_syllables") == 7, "ambiguous"), F.when(F.col("n_syllables") >= 10, "irregular"),
        F.when((F.col("n_syllables") == 9) & F.col("rhythm").isNull(), "long word inside"),
    ))
    df = df.withColumns({"segmented": F.coalesce("_placed.text", F.array_join(F.transform(w, lambda x: x["w"]), "")), "flags": flags})
    return df.withColumn("needs_review", (F.size("flags") > 0) & (F.col("kind") != "opener")).drop("_placed")


def resolved(words: Column) -> Column:
    """(n: numbers of syllables, changed: struct(w, was, now)) with other readings chosen by the meter, or null.

    words: struct(w, n, alts, ...); alts are all numbers a word can have. Of at
    most three words that have several, the one choice that brings the line to
    7 to 9 syllables is taken; where none or more than one does, or nothing
    would change, the meter has decided nothing.
    """
    several = F.filter(words, lambda w: F.coalesce(F.size(w["alts"]) > 1, F.lit(False)))
    base = total(words) - total(several)
    option = lambda i: F.coalesce(F.get(several, F.lit(i))["alts"], F.array(F.lit(0)))
    choices = F.flatten(F.transform(option(0), lambda x: F.flatten(F.transform(option(1), lambda y: F.transform(option(2), lambda z: F.array(x, y, z))))))
    fits = F.filter(choices, lambda c: (base + c[0] + c[1] + c[2]).between(7, 9))
    # Which of the words with several readings a word is: how many of them stand before it.
    nth = lambda i: F.size(F.filter(F.slice(words, 1, i), lambda w: F.coalesce(F.size(w["alts"]) > 1, F.lit(False))))
    one = F.get(fits, F.lit(0))
    numbers = F.transform(words, lambda w, i: F.when(F.coalesce(F.size(w["alts"]) > 1, F.lit(False)), F.get(one, nth(i))).otherwise(w["n"]))
    changed = F.filter(F.transform(words, lambda w, i: F.struct(w["w"].alias("w"), w["n"].alias("was"), F.get(numbers, i).alias("now"))), lambda x: x["was"] != x["now"])
    return F.when(F.size(several).between(1, 3) & (F.size(fits) == 1) & (F.size(changed) > 0), F.struct(numbers.alias("n"), changed.alias("changed")))


def beats_of(words: Column, beats: Column) -> Column:
    """(text, straddles): words put into three beats, one split where it crosses the end of a beat and its pieces are known.

    words: struct(w, n, pieces); pieces: array of struct(w, n), used only where
    there are two or more, they make up the word and their numbers add up to
    its. A piece is not split again; what crosses an end whole is a straddle.
    """
    first = F.get(beats, F.lit(0))
    second = first + F.get(beats, F.lit(1))
    start = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit(0).alias("pos"), F.lit(0).alias("beat"), F.lit(False).alias("over"))
    bound = lambda acc: F.when(acc["beat"] == 0, first).otherwise(second)

    def put(acc: Column, w: Column, n: Column) -> Column:
        pos, at = acc["pos"] + n, acc["beat"]
        ended = (at < 2) & (pos >= bound(acc))
        cell = lambda i, c: F.when(at == i, F.concat(acc[c], w)).otherwise(acc[c]).alias(c)
        return F.struct(cell(0, "a"), cell(1, "b"), cell(2, "c"), pos.alias("pos"), (at + ended.cast("int")).alias("beat"), (acc["over"] | (ended & (pos > bound(acc)))).alias("over"))

    def step(acc: Column, w: Column) -> Column:
        p = w["pieces"]
        known = F.coalesce((F.size(p) > 1) & (F.array_join(F.transform(p, lambda x: x["w"]), "") == w["w"]) & (total(p) == w["n"]), F.lit(False))
        crosses = (acc["beat"] < 2) & (acc["pos"] + w["n"] > bound(acc))
        units = F.when(known & crosses, F.transform(p, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n")))).otherwise(F.array(F.struct(w["w"].alias("w"), w["n"].alias("n"))))
        return F.aggregate(units, acc, lambda a, u: put(a, u["w"], u["n"]))

    done = F.aggregate(words, start, step)
    return F.struct(F.concat_ws(BAR, done["a"], done["b"], done["c"]).alias("text"), done["over"].alias("straddles"))


def line_analysis(df: DataFrame, words: str) -> DataFrame:
    """df with the whole analysis of a line: n_syllables, kind, rhythm, segmented, flags, needs_review, meter_resolved, numbers.

    words: array of struct(w, n, alts, pieces), see resolved and beats_of. Only
    a line whose first reading has not 7 to 9 syllables is read anew. Null and
    empty lines are openers without syllables.
    """
    empty = F.array().cast(df.schema[words].dataType)
    df = df.withColumn("_w", F.coalesce(F.col(words), empty)).withColumn("_first", total(F.col("_w")))
    df = df.withColumn("_fix", F.when(~F.col("_first").between(7, 9), resolved(F.col("_w"))))
    df = df.withColumn("numbers", F.coalesce(F.col("_fix.n"), F.transform("_w", lambda w: w["n"])))
    df = df.withColumn("_w", F.transform("_w", lambda w, i: w.withField("n", F.get(F.col("numbers"), i))))
    df = df.withColumn("n_syllables", total(F.col("_w"))).withColumn("kind", kind(F.col("n_syllables")))
    df = df.withColumn("rhythm", pattern(F.col("_w"))).withColumn("_placed", F.when(F.col("rhythm").isNotNull(), beats_of(F.col("_w"), F.col("rhythm"))))
    n, long = F.col("n_syllables"), F.exists("_w", lambda w: w["n"] >= 4)
    told = F.concat(F.lit("reading chosen by meter: "), F.array_join(F.transform("_fix.changed", lambda x: F.concat(x["w"], F.lit(" "), x["was"].cast("string"), F.lit("->"), x["now"].cast("string"))), ", "))
    note = (
        F.when(n <= 6, "opener (<=6 syllables) — short วรรค, expected").when(n >= 10, F.concat(n.cast("string"), F.lit(" syllables — likely shatter/miscount")))
        .when(n == 7, "7 syllables — ambiguous, [3,2,2] is only a guess").when((n == 9) & long & F.col("rhythm").isNull(), "4-syllable word not at วรรค edge")
    )
    flags = F.array_compact(F.array(F.when(F.col("_placed.straddles"), "word straddles a beat boundary"), F.when(F.col("_fix").isNotNull(), told), note))
    df = df.withColumns({
        "segmented": F.coalesce("_placed.text", F.array_join(F.transform("_w", lambda x: x["w"]), "")), "flags": flags,
        "meter_resolved": F.coalesce(F.col("_fix.changed"), F.array().cast("array<struct<w:string,was:int,now:int>>")),
    })
    return df.withColumn("needs_review", (F.size("flags") > 0) & (F.col("kind") != "opener")).drop("_w", "_first", "_fix", "_placed")


def is_orphan(token: Column, alone: list[str] | None = None) -> Column:
    """A single consonant that is no word by itself: one linking syllable."""
    return token.rlike("^[ก-ฮ]$") & ~token.isin(*(alone or [""]))


def counted(tokens: DataFrame, token: str, overrides: DataFrame, readings: DataFrame, alone: list[str] | None = None) -> DataFrame:
    """tokens with n (syllables), alts and origin: orphan, override (word, syllables), readings (word, counts, first first), none.

    A word of up to two characters that no list has counts one. Lists have a
    word once; the joins choose by measured size.
    """
    o = overrides.select(F.col("word").alias(token), F.size("syllables").alias("_o"))
    r = readings.select(F.col("word").alias(token), F.col("counts").alias("alts"))
    t = F.col(token)
    out = tokens.join(o, token, "left").join(r, token, "left")
    lone = is_orphan(t, alone)
    n = F.when(lone, 1).when(F.col("_o") > 0, F.col("_o")).when(F.size("alts") > 0, F.get("alts", F.lit(0))).when(F.length(t) <= 2, 1)
    origin = F.when(lone, "orphan").when(F.col("_o") > 0, "override").when(F.size("alts") > 0, "readings").when(F.length(t) <= 2, "short").otherwise("none")
    return out.withColumns({"n": n, "origin": origin}).drop("_o")


def manual_cut(line: Column, a: Column, b: Column, c: Column) -> Column:
    """What a reviewer's three cells say: deferred (all blank), exclude (x), cut, or rejected."""
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), EDGE, "")
    cells = [bare(x) for x in (a, b, c)]
    blank = (F.concat(*cells) == "")
    whole = (cells[0] != "") & (cells[1] != "") & (cells[2] != "") & (F.concat(*cells) == bare(line))
    return F.when(blank, "deferred").when(F.lower(cells[0]).eqNullSafe("x") & (cells[1] == "") & (cells[2] == ""), "exclude").when(whole, "cut").otherwise("rejected")


def import_answers(edited: DataFrame, lines: DataFrame, key: str = "wak") -> DataFrame:
    """edited rows with action; unknown for lines that lines does not have. Repeated lines of lines count once."""
    known = lines.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    out = edited.join(known, key, "left")
    return out.withColumn("action", F.when(F.col("_known").isNull(), "unknown").otherwise(manual_cut(F.col(key), F.col("a"), F.col("b"), F.col("c")))).drop("_known")
