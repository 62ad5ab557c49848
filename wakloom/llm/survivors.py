"""One surviving record for each group of records about the same thing.

The order of records is a key of comparable parts, so the best record and the
best value of every field are plain maxima: partial sums on the map side, one
shuffle, no group ever held as a list, even where one group is a third of all.

Currency reasoning (current_values) serves records without a date: which value
follows which is learned from dated records of all groups and kept as a table
of steps; joined with a group's values it gives the group's partial order, and
the current value is one that no other value of the group follows. No group is
listed and nothing is learned on the driver, so a field may have any number of
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.llm.canon import look_alike
from wakloom.operators.ranking import global_rank, with_neighbour
from wakloom.session import settle

# The dictionaries, most trusted first.
DICTIONARIES = ("poetry_overrides", "poetry_overrides_base", "poetry_overrides_generated_lenient")


def missing(df: DataFrame, name: str) -> Column:
    """Null, an empty array, or a string of blanks."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StringType):
        return c.isNull() | ~c.rlike(r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]")
    return c.isNull()


def rank_of(df: DataFrame, fields: list[str]) -> Column:
    """The larger the better: dictionary, later date (none: last), fewer missing values, smaller id."""
    trust = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in DICTIONARIES]), F.col("dict_name")), F.lit(0))
    trust = F.when(trust == 0, len(DICTIONARIES) + 1).otherwise(trust)
    gaps = sum((missing(df, f).cast("int") for f in fields), F.lit(0))
    return F.struct((-trust).alias("trust"), F.col("updated_at").alias("at"), (-gaps).alias("gaps"), (-F.col("entry_id")).alias("id"))


def survivors(entries: DataFrame, fields: tuple[str, ...] = ("syllables", "ipa", "n_seen", "note")) -> DataFrame:
    """group_id, survivor_id, n_entries, word, and of each field its value and the id it comes from (f, f_from).

    A group is two or more entries whose words look the same. Null words and
    words without ink form no group. A field that all entries miss is null and
    comes from 0. Ties end at the smaller entry_id, which must be unique.
    """
    rank = rank_of(entries, list(fields))
    rows = entries.select("entry_id", "word", *fields, look_alike("word").alias("_look"), rank.alias("_rank"), *[missing(entries, f).alias(f"_no_{f}") for f in fields])
    best = F.max(F.struct("_rank", "word")).alias("_best")
    each = [F.max(F.when(~F.col(f"_no_{f}"), F.struct("_rank", f))).alias(f"_{f}") for f in fields]
    groups = rows.where("_look <> ''").groupBy("_look").agg(F.min("entry_id").alias("group_id"), F.count("*").alias("n_entries"), best, *each).where("n_entries > 1")
    values = [c for f in fields for c in (F.col(f"_{f}.{f}").alias(f), F.coalesce(-F.col(f"_{f}._rank.id"), F.lit(0).cast("long")).alias(f"{f}_from"))]
    return groups.select("group_id", (-F.col("_best._rank.id")).alias("survivor_id"), "n_entries", F.col("_best.word").alias("word"), *values)


def learn_steps(seen: DataFrame, support: int = 2) -> DataFrame:
    """older, newer: values of which one follows the other in at least support groups, and in more than the other way round.

    seen: look, value, first_at; one row per group and value. A step is a pair
    of values next to each other by date in a group.
    """
    dated = seen.where("first_at is not null").select("look", "first_at", "value")
    ranked = global_rank(dated, ["look", "first_at", "value"], "_at")  # not a window: a group may hold a third of all rows
    pairs = with_neighbour(ranked, "_at", ["look"], {"before": "value"}, -1).where("before is not null")
    steps = pairs.groupBy(F.col("before").alias("older"), F.col("value").alias("newer")).agg(F.count("*").alias("n"))
    back = steps.select(F.col("newer").alias("older"), F.col("older").alias("newer"), F.col("n").alias("m"))
    return steps.join(back, ["older", "newer"], "left").where((F.col("n") >= support) & (F.col("n") > F.coalesce("m", F.lit(0)))).select("older", "newer")


def current_values(entries: DataFrame, field: str, support: int = 2) -> DataFrame:
    """group_id, value (as text): of each group the current value of a field.

    Dated values follow each other by date. Where one of two has no date, a
    learned step from one to the other decides (steps, not chains of steps).
    Among values that nothing follows, the later dated, then the smaller text
    is taken; where each is followed by another, among all. Groups without any
    value are left out.
    """
    value = F.col(field) if isinstance(entries.schema[field].dataType, T.StringType) else F.to_json(F.struct(field)) if isinstance(entries.schema[field].dataType, T.ArrayType) else F.col(field).cast("string")
    rows = entries.select("entry_id", look_alike("word").alias("look"), F.when(~missing(entries, field), value).alias("value"), "updated_at").where("look <> ''")
    ids = rows.groupBy("look").agg(F.min("entry_id").alias("group_id"))
    seen = settle(rows.where("value is not null").groupBy("look", "value").agg(F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at")), "seen")
    steps = learn_steps(seen, support)
    latest = seen.groupBy("look").agg(F.max("last_at").alias("latest"))
    # A dated value is followed by a later dated one; beside that a value by one that a learned step leads to, if one of both has no date.
    mine = seen.join(latest, "look").withColumn("late", F.coalesce(F.col("last_at") < F.col("latest"), F.lit(False)))
    to = seen.join(steps, F.col("value") == F.col("older")).select("look", F.col("older").alias("value"), F.col("newer"), F.col("last_at").isNull().alias("open"))
    newer = seen.select("look", F.col("value").alias("newer"), F.col("last_at").isNull().alias("open2"))
    followed = to.join(newer, ["look", "newer"]).where("open or open2").select("look", "value").distinct().withColumn("step", F.lit(True))
    known = mine.join(followed, ["look", "value"], "left").withColumn("free", ~F.col("late") & F.col("step").isNull())
    # The best by: nothing follows it, later date (none: last), smaller text.
    free = known.groupBy("look").agg(F.min(F.struct((~F.col("free")).alias("a"), F.col("last_at").isNull().alias("b"), (-F.unix_micros(F.col("last_at").cast("timestamp"))).alias("c"), F.col("value").alias("v"))).alias("best"))
    return free.join(ids, "look").select("group_id", F.col("best.v").alias("value"))
