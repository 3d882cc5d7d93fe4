"""Queries for packing, streams and learned ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import learned, packing
from corvane.plans.registry import query, table
from corvane.session import ensure_checkpoint_dir
from corvane.streaming import watch


def options(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as queries, sizes as groups, parts as options; the first option is to leave the group out."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("query_id"), F.col("p_size").cast("long").alias("id"), F.col("p_partkey").cast("string").alias("level"), (F.col("p_partkey") % 40 + 1).alias("cost"), F.col("p_retailprice").alias("value"))
    none = rows.select("query_id", "id").distinct().select("query_id", "id", F.lit("omit").alias("level"), F.lit(0).cast("long").alias("cost"), F.lit(0.0).alias("value"))
    return rows.unionByName(none), rows.select("query_id").distinct().withColumn("budget", F.lit(200))


@query()
def knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.choose(*options(spark, sf_dir))


def _best_sql(groups: int = 50, budget: int = 200) -> str:
    """The greatest value by group after group, for each budget that can be used up: as many CTEs as there are sizes of parts."""
    out = "o AS (SELECT p_brand AS q, p_size AS g, p_partkey % 40 + 1 AS cost, p_retailprice AS value FROM part UNION ALL SELECT DISTINCT p_brand, s.g, 0, 0.0 FROM part, (SELECT unnest(range(1, " + str(groups + 1) + ")) AS g) s), d0 AS (SELECT DISTINCT p_brand AS q, 0 AS used, 0.0::DOUBLE AS value FROM part)"
    for i in range(1, groups + 1):
        out += f", d{i} AS (SELECT d.q, used + cost AS used, max(d.value + o.value) AS value FROM d{i - 1} d JOIN o ON o.q = d.q AND o.g = {i} WHERE used + cost <= {budget} GROUP BY d.q, used + cost)"
    return f"WITH {out} SELECT q AS query_id, round(max(value), 4) AS value FROM d{groups} GROUP BY 1"


@query(_best_sql())
def knapsack_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chosen parts of each brand are worth in all: no other choice within the budget is worth more."""
    return packing.choose(*options(spark, sf_dir)).groupBy("query_id").agg(F.round(F.sum("value"), 4).alias("value"))


@query()
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.choose(*options(spark, sf_dir), method="greedy")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are classes, their customers methods."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    row = lambda df, id, parent, name, kind, line: df.select(id.alias("id"), parent.alias("parent_id"), F.lit("tree.py").alias("path"), name.alias("qualname"), F.lit(kind).alias("kind"), line.cast("int").alias("start_line"), (line + 1).cast("int").alias("end_line"), F.concat(F.lit("def "), name).alias("signature"), F.lit(None).cast("string").alias("docstring"), F.repeat(name, 2).alias("body"))
    return row(nation, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit(None).cast("string"), F.col("n_name"), "class", F.col("n_nationkey") + 1).unionByName(
        row(customer, F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_name"), "method", F.col("c_custkey") + 100)
    )


@query()
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best customers of each segment as context of 4,000 bytes, with the headers of their nations."""
    customer = table(spark, sf_dir, "customer")
    from pyspark.sql import Window

    scores = customer.filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") / 10_000).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 20")
    return packing.pack(symbols(spark, sf_dir), ranked, ranked.select("query_id").distinct().withColumn("budget", F.lit(4_000)))


@query(
    """SELECT 'c' || c_custkey AS id, octet_length(encode('tree.py:' || (n_nationkey + 1) || ' ' || n_name || chr(10) || 'def ' || n_name || chr(10) || '# ... lines ' || (n_nationkey + 1) || '-' || (n_nationkey + 2) || ' omitted' || chr(10) || 'tree.py:' || (c_custkey + 100) || ' ' || c_name || chr(10)))::BIGINT AS cost, 0.15::DOUBLE AS value
FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def name_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest representation of each customer under the header of its nation."""
    s = symbols(spark, sf_dir)
    scores = s.filter("kind = 'method'").select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("score"))
    return packing.representations(s, scores).filter("level = 'name'").select("id", "cost", "value")


@query("SELECT 'n' || c_nationkey AS ancestor, 'c' || c_custkey AS id FROM customer")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.ancestors(symbols(spark, sf_dir))


@query(
    """WITH RECURSIVE f AS (SELECT p_brand AS b, p_partkey AS k, p_size AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
t AS (SELECT b, 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS k, false AS took FROM f GROUP BY b
  UNION ALL SELECT f.b, f.r, CASE WHEN used + c <= 120 THEN used + c ELSE used END, f.k, used + c <= 120 FROM t JOIN f ON f.b = t.b AND f.r = t.r + 1)
SELECT b AS p_brand, k AS p_partkey FROM t WHERE took"""
)
def memory_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of key, each part that still fits."""
    return packing.preamble(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], "p_size", 120)


@query(
    """WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM e)
SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS quiet_at FROM s GROUP BY user_id, burst"""
)
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events with a gap of 30 minutes."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), "ts")
    return watch.debounced(events, "30 minutes", key="user_id").select("user_id", "n", F.col("started").cast("timestamp_ntz").alias("started"), F.col("quiet_at").cast("timestamp_ntz").alias("quiet_at"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM e)
SELECT user_id, count(*) AS n, min(ts) AS started FROM s GROUP BY user_id, burst HAVING max(ts) + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events)"""
)
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: a burst is emitted when the watermark passes its end, so those still open at the last event stay in the state."""
    import os

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parque[t]")
    out = f"{ensure_checkpoint_dir(spark)}/debounce-{uuid.uuid4().hex}"
    bursts = watch.debounced(events.select("user_id", F.col("event_type").alias("kind"), "ts"), "30 minutes", "0 seconds", key="user_id")
    stream = bursts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("user_id bigint, kind string, n bigint, started timestamp, quiet_at timestamp").parquet(f"{out}/rows").select("user_id", "n", F.col("started").cast("timestamp_ntz").alias("started"))


@query()
def learned_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels from text statistics, balanced logistic steps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    rows = docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("y"), F.log1p(F.length(text)).alias("size"), ((F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>!]", ""))) / (F.length(text) + 1)).alias("signs"), F.lit("validation").alias("split"))
    model = learned.fit(rows, ["size", "signs"], "y", steps=25)
    return rows.select("doc_id", F.col("y").cast("int").alias("y"), F.round(model.logit(["size", "signs"]), 6).alias("logit"))
