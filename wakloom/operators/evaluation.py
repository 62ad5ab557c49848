"""Tables of an evaluation: verdicts joined with gold, rates by rule, operator and story, seams of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakloom.operators.metrics import confusion, with_metrics

STANZA = ["w1", "w2", "w3", "w4", "prev_w4"]


def join_verdicts(instances: DataFrame, verdicts: DataFrame, key: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """instances with the verdict columns of the same text; null equals null in the key. A text has one verdict."""
    key, keep = key or STANZA, keep or [c for c in verdicts.columns if c not in (key or STANZA)]
    v = verdicts.select(*[F.col(k).alias(f"_{k}") for k in key], *keep).dropDuplicates([f"_{k}" for k in key])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return instances.join(v, on, "left").drop(*[f"_{k}" for k in key])


def summary(instances: DataFrame, key: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """key, n_instances and all metrics of labelled instances."""
    return with_metrics(instances.groupBy(*key).agg(F.count("*").alias("n_instances"), *confusion(gold, pred)))


def merged_counts(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Confusion counts of several tables added, with the metrics of the sums."""
    cols = ["tp", "fp", "fn", "tn", "dropped"]
    both = parts[0].select(*key, *cols)
    for p in parts[1:]:
        both = both.unionByName(p.select(*key, *cols))
    return with_metrics(both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in cols]))


def by_operator(instances: DataFrame, key: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """key with n, fp, fn and recall: a missing prediction of a positive is a miss."""
    g, yes = F.col(gold), F.coalesce(F.col(pred), F.lit(False))
    n, tp = F.count_if(g), F.count_if(g & yes)
    return instances.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~g & yes).alias("fp"), F.count_if(g & ~yes).alias("fn"), F.when(n > 0, F.round(tp / n, 6)).alias("recall"))


def accept_rate(ok: Column, n: Column) -> Column:
    """Per cent accepted, 0 of nothing."""
    return F.round(100 * ok / F.greatest(n, F.lit(1)), 2)


def seam_summary(seams: DataFrame, ok: str, key: list[str], order: list[str], shown: list[str], first: int = 10) -> DataFrame:
    """key, boundaries, rhyme, n_exceptions, exceptions: the first ones in the order, by their shown columns."""
    w = Window.partitionBy(*key, "_bad").orderBy(*order)
    bad = ~F.coalesce(F.col(ok), F.lit(False))
    marked = seams.withColumn("_bad", bad).withColumn("_n", F.row_number().over(w))
    few = F.when(F.col("_bad") & (F.col("_n") <= first), F.struct("_n", F.concat_ws("|", *shown).alias("t")))  # a list of at most `first`
    out = marked.groupBy(*key).agg(F.count("*").alias("boundaries"), F.count_if(~F.col("_bad")).alias("rhyme"), F.count_if("_bad").alias("n_exceptions"), F.array_sort(F.collect_list(few)).alias("_x"))
    return out.withColumn("exceptions", F.transform("_x", lambda x: x["t"])).drop("_x")


def shares(df: DataFrame, key: list[str]) -> DataFrame:
    """key, n and per cent of all rows, halves to the even number."""
    part = df.groupBy(*key).agg(F.count("*").alias("n"))
    return part.join(F.broadcast(part.agg(F.sum("n").alias("_all")))).withColumn("percent", F.bround(100 * F.col("n") / F.col("_all"), 1)).drop("_all")  # one row


def rules_of_messages(messages: Column) -> Column:
    """struct(r1, r2, r3, rx) out of validator messages; null where it could not judge the poem."""
    failed = lambda k: ~F.exists(messages, lambda m: m.startswith("Rhyme error") & (F.regexp_extract(m, r"\(Wak (\d)\)", 1) == k))
    rules = F.struct(failed("1").alias("r1"), failed("2").alias("r2"), failed("3").alias("r3"), (~F.exists(messages, lambda m: m.startswith("Inter-stanza rhyme error"))).alias("rx"))
    judged = ~F.exists(messages, lambda m: m.startswith("The poem does not have") | m.startswith("Something went wrong"))
    return F.when(judged, rules)


def parity(a: DataFrame, b: DataFrame, key: list[str], rules: list[str]) -> DataFrame:
    """check, status, n: how often two judges agree on each rule: ok, mismatch, bail (one did not judge)."""
    x, y = a.select(*key, *[F.col(r).alias(f"a_{r}") for r in rules]), b.select(*key, *[F.col(r).alias(f"b_{r}") for r in rules])
    status = lambda r: F.when(F.col(f"a_{r}").isNull() | F.col(f"b_{r}").isNull(), "bail").when(F.col(f"a_{r}") == F.col(f"b_{r}"), "ok").otherwise("mismatch")
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("check"), status(r).alias("status")) for r in rules])).alias("c")
    return x.join(y, key).select(cells).select("c.*").groupBy("check", "status").agg(F.count("*").alias("n"))


def traps(pool: DataFrame, targets: DataFrame, syllable: str, old: str, new: str) -> DataFrame:
    """target, candidate: syllables of one old class whose new classes differ; the pool is summed to (old, new, least syllable) first, so hot classes are never paired out."""
    t = targets.select(F.col(syllable).alias("target"), F.col(old).alias("_old"), F.col(new).alias("_t"))
    few = pool.where(F.col(new).isNotNull()).groupBy(F.col(old).alias("_old"), F.col(new).alias("_c")).agg(F.min(syllable).alias("candidate"))
    return t.join(few, "_old").where("_t <> _c and target <> candidate").select("target", "candidate")


def not_avoided(candidates: DataFrame, avoid: DataFrame, key: str, rhyme: str) -> DataFrame:
    """candidates whose rhyme is none of those to avoid under the same key."""
    return candidates.join(avoid.select(key, rhyme).distinct(), [key, rhyme], "left_anti")


def unused(pairs: DataFrame, used: DataFrame, a: str, b: str) -> DataFrame:
    """pairs of two unlike parts that used does not have."""
    return pairs.where(F.col(a) != F.col(b)).join(used.select(a, b).distinct(), [a, b], "left_anti")
