"""Candidate pools for altered stanzas: which syllable may stand for which.

Tables of syllables (syll, vowel, final_class, rhyme) are joined on their
classes; quotas are ranks within a class in an order by hash, the same in every
run. Nothing depends on the order in which stanzas are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakloom.functions.text import replace_suffix

# Short vowels and the long ones they are taken for.
SWAPS = {"อะ": "อา", "อิ": "อี", "อึ": "อือ", "อุ": "อู", "เอะ": "เอ", "แอะ": "แอ", "โอะ": "โอ", "เอาะ": "ออ", "เออะ": "เออ"}
LOOK = 8  # places looked at for each candidate wanted
SWAPS |= {v: k for k, v in SWAPS.items()}


def order_of(seed: int, *cols: str) -> Column:
    """An order that looks random and does not change."""
    return F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *cols))


def capped(df: DataFrame, key: list[str], seed: int, by: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key: a quota that is the operator's own meaning."""
    w = Window.partitionBy(*key).orderBy(order_of(seed, *by), *by)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def class_pairs(syllables: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """rhyme, a, b: up to `most` pairs a < b of each rhyme class.

    A class of n syllables is not joined with itself: each syllable meets the
    next ones in the hash order, at k = 1, 2, ... places, only as far as the
    quota needs.
    """
    s = syllables.where(F.col("rhyme").isNotNull()).select("rhyme", "syll").distinct()
    w = Window.partitionBy("rhyme").orderBy(order_of(seed, "syll"), "syll")
    placed = s.withColumn("at", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy("rhyme")))
    # n(n-1)/2 pairs exist; steps 1..k give about n of them each.
    reach = F.least(F.col("size") - 1, F.ceil(F.lit(most) / F.greatest(F.col("size") - 1, F.lit(1))) + 1).cast("int")
    near = placed.where("size > 1").select("rhyme", F.col("syll").alias("x"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + reach)).alias("at"))
    pairs = near.join(placed.select("rhyme", F.col("syll").alias("y"), "at"), ["rhyme", "at"])
    pairs = pairs.select("rhyme", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return capped(pairs, ["rhyme"], seed, ["a", "b"], most)


def candidates(syllables: DataFrame, how: str, per: int = 4, seed: int = 42) -> DataFrame:
    """syll, candidate, how: up to `per` syllables for each that may stand in its place but do not rhyme.

    same_final, same_vowel, or swapped (the vowel of the other length, same
    final). A class is a ring in hash order; a syllable looks at the next
    LOOK * per places from its own hash on, so no class is joined with itself.
    """
    s = syllables.where("syll <> ''").select("syll", "vowel", "final_class", "rhyme").distinct()
    swap = F.create_map(*[F.lit(x) for kv in sorted(SWAPS.items()) for x in kv])
    both = lambda v: F.concat_ws(" ", v, F.col("final_class"))
    want, mine = {"same_final": (F.col("final_class"),) * 2, "same_vowel": (F.col("vowel"),) * 2, "swapped": (F.when(F.try_element_at(swap, F.col("vowel")).isNotNull(), both(F.try_element_at(swap, F.col("vowel")))), both(F.col("vowel")))}[how]
    w = Window.partitionBy("class").orderBy(order_of(seed, "candidate"), "candidate")
    ring = s.select(F.col("syll").alias("candidate"), mine.alias("class"), F.col("rhyme").alias("_r")).withColumn("at", F.row_number().over(w) - 1)
    sizes = ring.groupBy("class").agg(F.count("*").alias("size"))
    asks = s.select("syll", "rhyme", want.alias("class")).where("class is not null").join(sizes, "class")
    start = F.pmod(F.xxhash64("syll"), F.col("size"))
    asks = asks.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(LOOK * per)).cast("int") - 1))).withColumn("at", F.pmod(start + F.col("k"), F.col("size")).cast("int"))
    found = asks.join(ring, ["class", "at"]).where("not (rhyme <=> _r) and syll <> candidate")
    return capped(found.select("syll", "candidate", F.lit(how).alias("how")), ["syll"], seed, ["candidate"], per)


def altered(stanzas: DataFrame, pool: DataFrame, line: str, tail: str, key: list[str], quota: int, seed: int = 42) -> DataFrame:
    """stanzas whose line ends in tail, with another syllable there: new_line, candidate.

    Each stanza gets one candidate by hash, then at most quota rows for each
    way. pool holds at most a quota of candidates for each syllable.
    """
    one = stanzas.where(F.col(line).endswith(F.col(tail))).join(pool.withColumnRenamed("syll", tail), tail)
    pick = one.groupBy(*key, "how").agg(F.min_by(F.struct(line, tail, "candidate"), order_of(seed, *key, "candidate")).alias("p"))
    out = pick.select(*key, "how", "p.*").withColumn("new_line", replace_suffix(line, tail, "candidate"))
    return capped(out, ["how"], seed, key, quota)
