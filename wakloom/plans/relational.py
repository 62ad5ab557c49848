"""Queries of the general relational forms over the star-schema and event tables, each with its SQL.

Money sums are made in DECIMAL so that results do not depend on the order of
addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakloom.operators import dictionary, ranking
from wakloom.session import table
from wakloom.streaming.incremental import changed_rows, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def money(c: str):
    return F.col(c).cast("decimal(18,4)")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def rel_star_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Revenue is summed to the customer before the dimensions come in.
    part = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum(money("l_extendedprice")).alias("r"), F.count("*").alias("k"))
    return part.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"), F.sum("k").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def rel_semi_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_anti")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)
SELECT o_orderkey, k, date_diff('day', before::DATE, o_orderdate::DATE) AS gap, run::DOUBLE AS running FROM d""")
def rel_running_totals(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = o.withColumns({"k": F.row_number().over(w), "before": F.lag("o_orderdate").over(w), "running": F.sum(money("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")})
    return o.select("o_orderkey", "k", F.datediff(F.to_date("o_orderdate"), F.to_date("before")).alias("gap"), "running")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY user_id, session""")
def rel_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    opens = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    s = e.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def str_hourly_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "2 hours", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT word_id, word, ipa FROM (SELECT DISTINCT word_id, word, ipa FROM overrides_main) m WHERE NOT EXISTS (SELECT 1 FROM overrides_space s WHERE s.word_id = m.word_id AND s.word IS NOT DISTINCT FROM m.word AND s.ipa IS NOT DISTINCT FROM m.ipa)""")
def str_changed_rows(spark, sf_dir):
    cols = ["word_id", "word", "ipa"]
    return changed_rows(table(spark, sf_dir, "overrides_main").select(*cols).distinct(), table(spark, sf_dir, "overrides_space").select(*cols), cols)


@query("""WITH m AS (SELECT DISTINCT word_id, n_seen FROM overrides_main), s AS (SELECT word_id, max(n_seen) AS n_seen FROM overrides_space WHERE n_seen > 50 GROUP BY word_id) SELECT * FROM m WHERE word_id NOT IN (SELECT word_id FROM s) UNION ALL SELECT * FROM s""")
def snk_upsert(spark, sf_dir):
    m = table(spark, sf_dir, "overrides_main").select("word_id", "n_seen").distinct()
    return dictionary.upsert(m, table(spark, sf_dir, "overrides_space").where("n_seen > 50").groupBy("word_id").agg(F.max("n_seen").alias("n_seen")), ["word_id"])


@query("""SELECT l_orderkey, l_linenumber, ((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 3000)::BIGINT AS chunk FROM lineitem""")
def win_chunks(spark, sf_dir):
    return ranking.chunks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 3000, "chunk")


@query("""SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS mean_square FROM embeddings GROUP BY label""")
def fun_vectors(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("label", square.alias("q")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("mean_square"))


@query("""SELECT coalesce(source, '?') AS source, count(*) AS n, count(text) AS n_text, sum(length(text))::BIGINT AS n_points, count(*) FILTER (text = '') AS n_empty, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS n_off FROM documents GROUP BY ALL""")
def agg_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "text", "n_chars")
    return d.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.sum(F.length("text")).alias("n_points"), F.count_if(F.col("text") == "").alias("n_empty"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("n_off"))
