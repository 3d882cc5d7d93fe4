"""Queries for the fact log; events stand in for operations, users for facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.operators import branches as B
from corvane.operators import memory as M
from corvane.plans.registry import query, table
from corvane.plans.retrieval import bm25f_sql

LOG_SQL = """log AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, user_id::VARCHAR AS fact_id, ts AS recorded_at,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'invalidate' ELSE 'update' END AS kind, event_type || ':' || event_id AS payload FROM events)"""
STATE_SQL = "SELECT fact_id, payload, seq FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY seq DESC) AS r FROM {0}) WHERE r = 1 AND kind <> 'invalidate'"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are counted within a fact, so no window holds the whole log."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "invalidate").otherwise("update")
    return events.select(
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        "event_id",
        F.col("user_id").cast("string").alias("fact_id"),
        F.col("ts").alias("recorded_at"),
        kind.alias("kind"),
        F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("payload"),
    )


@query(f"WITH {LOG_SQL} {STATE_SQL.format('log')}")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.replay(log(spark, sf_dir)).select("fact_id", "payload", "seq")


@query(f"WITH {LOG_SQL}, a AS ({STATE_SQL.format('(SELECT * FROM log WHERE seq <= 20)')}), b AS ({STATE_SQL.format('log')}) SELECT coalesce(a.fact_id, b.fact_id) AS fact_id, CASE WHEN a.fact_id IS NULL THEN 'added' WHEN b.fact_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.payload AS before, b.payload AS after FROM a FULL JOIN b ON a.fact_id = b.fact_id WHERE a.payload IS DISTINCT FROM b.payload")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log(spark, sf_dir)
    return M.diff(M.replay(ops.filter("seq <= 20")), M.replay(ops))


@query(f"WITH {LOG_SQL} SELECT fact_id, seq, before, payload AS after FROM (SELECT *, lag(payload) OVER (PARTITION BY fact_id ORDER BY seq) AS before FROM log) WHERE kind = 'update'")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.audit(log(spark, sf_dir))


@query(f"WITH {LOG_SQL}, p AS (SELECT fact_id, seq, epoch_us(date_trunc('hour', recorded_at)) - seq AS l FROM log) SELECT fact_id, seq, max(l) OVER (PARTITION BY fact_id ORDER BY seq) + seq AS micros FROM p")
def monotone_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to the hour collide; each becomes later than the one before."""
    rows = log(spark, sf_dir).select("fact_id", "seq", F.date_trunc("hour", F.col("recorded_at").cast("timestamp")).alias("recorded_at"))
    return M.monotone(rows, ["fact_id"], ["seq"], "recorded_at").select("fact_id", "seq", F.unix_micros("recorded_at").alias("micros"))


MERGE_SQL = f"""{LOG_SQL}, base AS ({STATE_SQL.format('(SELECT * FROM log WHERE seq <= 10)')}),
ours AS ({STATE_SQL.format('(SELECT * FROM log WHERE seq <= 10 OR (seq <= 14 AND event_id % 2 = 0))')}), theirs AS ({STATE_SQL.format('(SELECT * FROM log WHERE seq <= 10 OR (seq <= 14 AND event_id % 2 = 1))')}),
j AS (SELECT coalesce(b.fact_id, o.fact_id, t.fact_id) AS fact_id, b.payload AS b, o.payload AS o, t.payload AS t FROM base b FULL JOIN ours o ON o.fact_id = b.fact_id FULL JOIN theirs t ON t.fact_id = coalesce(b.fact_id, o.fact_id)),
preview AS (SELECT fact_id, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o END AS payload,
  CASE WHEN o IS NOT DISTINCT FROM t OR o IS NOT DISTINCT FROM b OR t IS NOT DISTINCT FROM b THEN NULL WHEN o IS NULL OR t IS NULL THEN 'delete_update' ELSE 'concurrent_update' END AS conflict, b AS base, o AS ours, t AS theirs FROM j)"""


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten operations of each fact are common; then even events are ours and odd ones theirs."""
    ops = log(spark, sf_dir)
    state = lambda cond: M.replay(ops.filter(cond))
    return M.merge_preview(state("seq <= 10"), state("seq <= 10 OR (seq <= 14 AND event_id % 2 = 0)"), state("seq <= 10 OR (seq <= 14 AND event_id % 2 = 1)"))


@query(f"WITH {MERGE_SQL} SELECT * FROM preview")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(spark, sf_dir)


@query(f"WITH {MERGE_SQL} SELECT fact_id, CASE WHEN conflict IS NOT NULL THEN CASE fact_id::INT % 3 WHEN 0 THEN ours WHEN 1 THEN theirs END ELSE payload END AS payload FROM preview WHERE CASE WHEN conflict IS NOT NULL THEN CASE fact_id::INT % 3 WHEN 0 THEN ours WHEN 1 THEN theirs END ELSE payload END IS NOT NULL")
def merge_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preview(spark, sf_dir).persist()
    choice = F.element_at(F.array(*map(F.lit, ("ours", "theirs", "delete"))), F.col("fact_id").cast("int") % 3 + 1)
    return M.merge(found, found.filter("conflict is not null").select("fact_id", choice.alias("choice")))


DERIVED_SQL = "derived AS (SELECT c_custkey // 2 AS source_id, c_custkey AS derived_id FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey > 2)"


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with diamonds: each customer derives from two smaller ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return c.filter("k > 1").select(F.expr("k div 2").alias("source_id"), F.col("k").alias("derived_id")).unionByName(c.filter("k > 2").select(F.expr("k div 3").alias("source_id"), F.col("k").alias("derived_id")))


@query(f"WITH RECURSIVE {DERIVED_SQL}, r AS (SELECT root, root AS id FROM (VALUES (7), (40)) v(root) UNION SELECT root, derived_id FROM r JOIN derived ON source_id = id) SELECT root::BIGINT AS root, id::BIGINT AS id FROM r WHERE root <> id")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dependents(derivations(spark, sf_dir), spark.sql("SELECT cast(id as bigint) id FROM VALUES (7), (40) AS t(id)"))


@query(f"WITH RECURSIVE {DERIVED_SQL}, r AS (SELECT 7 AS id UNION SELECT derived_id FROM r JOIN derived ON source_id = id) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM r)")
def forget_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer 7 and all that derives from it are forgotten in the table of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("long").alias("fact_id"))
    kept, _ = M.forget({"orders": orders}, derivations(spark, sf_dir), spark.sql("SELECT cast(7 as bigint) AS id"))
    return kept["orders"].select("o_orderkey", "o_custkey")


OPS_SQL = "ops AS (SELECT o_orderkey AS op_id, CASE WHEN o_orderkey <= 1 THEN [] WHEN o_orderkey % 5 = 0 THEN [o_orderkey // 2, o_orderkey // 3] ELSE [o_orderkey // 2] END AS parents FROM orders), e AS (SELECT op_id, unnest(parents) AS parent FROM ops)"
REACH_SQL = "r AS (SELECT o_orderkey AS root, o_orderkey AS id FROM orders WHERE {0} UNION SELECT root, parent FROM r JOIN e ON op_id = id)"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of operations with merges: all orders, each after one or two with lesser keys."""
    k = F.col("o_orderkey").cast("long")
    half, third = F.expr("o_orderkey div 2"), F.expr("o_orderkey div 3")
    parents = F.when(k <= 1, F.array().cast("array<bigint>")).when(k % 5 == 0, F.array(half, third)).otherwise(F.array(half))
    return table(spark, sf_dir, "orders").select(k.alias("op_id"), parents.alias("parents"))


def heads(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").filter(condition).select(k.alias("root"), k.alias("id"))


@query(f"WITH RECURSIVE {OPS_SQL}, {REACH_SQL.format('o_orderkey % 100 = 0')} SELECT root::BIGINT AS root, id::BIGINT AS id FROM r")
def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operation whose key is divisible by 100 reaches among all."""
    return M.ancestry(operations(spark, sf_dir), heads(spark, sf_dir, "o_orderkey % 100 = 0"))


@query(f"WITH RECURSIVE {OPS_SQL}, {REACH_SQL.format('o_orderkey >= (SELECT max(o_orderkey) - 1 FROM orders)')}, c AS (SELECT id FROM r GROUP BY id HAVING count(*) = 2) SELECT id::BIGINT AS op_id FROM c WHERE id NOT IN (SELECT parent FROM e WHERE op_id IN (SELECT id FROM c))")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two last operations."""
    ops = operations(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    found = M.ancestry(ops, heads(spark, sf_dir, f"o_orderkey >= {last - 1}"))
    return M.common_base(found.filter(F.col("root") == last), found.filter(F.col("root") == last - 1), ops)


#: Orders as commits along first parents; each changes one of fifty facts.
LINE_SQL = "commits AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS up, (o_custkey % 50)::VARCHAR AS fact_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || ':' || o_orderkey END AS payload FROM orders), line AS (SELECT id AS root, id FROM commits WHERE id % 100 = 0 UNION ALL SELECT root, up FROM line JOIN commits USING (id) WHERE up IS NOT NULL)"


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("long")
    made = operations(spark, sf_dir).withColumnRenamed("op_id", "commit_id")
    payload = F.when(k % 7 != 0, F.concat("o_orderstatus", F.lit(":"), k.cast("string")))
    return made, orders.select(k.alias("op_id"), k.alias("commit_id"), k.alias("seq"), (F.col("o_custkey") % 50).cast("string").alias("fact_id"), payload.alias("payload"))


@query(f"WITH RECURSIVE {LINE_SQL} SELECT root, fact_id, payload FROM (SELECT root, fact_id, payload, row_number() OVER (PARTITION BY root, fact_id ORDER BY id DESC) AS r FROM line JOIN commits USING (id)) WHERE r = 1 AND payload IS NOT NULL")
def branch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts at each commit whose key is divisible by 100."""
    made, ops = commits(spark, sf_dir)
    return B.states(made, ops, heads(spark, sf_dir, "o_orderkey % 100 = 0")).select("root", "fact_id", "payload")


@query(f"WITH RECURSIVE {LINE_SQL}, t AS (SELECT l.root, c.id, c.payload FROM line l JOIN commits c USING (id) JOIN commits x ON x.id = l.root AND x.fact_id = c.fact_id AND c.id < x.id), b AS (SELECT root, payload FROM t QUALIFY row_number() OVER (PARTITION BY root ORDER BY id DESC) = 1) SELECT c.id AS op_id, fact_id, b.payload FROM commits c LEFT JOIN b ON b.root = c.id WHERE c.id % 100 = 0")
def reverted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reverting each operation whose key is divisible by 100 puts back."""
    made, ops = commits(spark, sf_dir)
    return B.before(made, ops, ops.filter("op_id % 100 = 0").select("op_id"))


ANCHORS_SQL = "anchors AS (SELECT l_orderkey AS fact_id, l_partkey AS symbol_id, min(p_size) AS content_hash FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), symbols AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS id, CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size END AS hash FROM part WHERE p_partkey % 19 <> 0), renames AS (SELECT p_partkey AS old_id, p_partkey + 1000000 AS new_id FROM part WHERE p_partkey % 13 = 0)"


def anchored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    k = F.col("p_partkey")
    anchors = lines.join(part.hint("merge"), lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("symbol_id")).agg(F.min("p_size").alias("content_hash"))
    symbols = part.filter(k % 19 != 0).select(F.when(k % 13 == 0, k + 1_000_000).otherwise(k).alias("id"), F.when(k % 17 == 0, -1).otherwise(F.col("p_size")).alias("hash"))
    return anchors, symbols, part.filter(k % 13 == 0).select(k.alias("old_id"), (k + 1_000_000).alias("new_id"))


@query(f"WITH {ANCHORS_SQL} SELECT fact_id, symbol_id, CASE WHEN s.id IS NULL THEN 'orphaned' WHEN s.hash = content_hash THEN 'fresh' ELSE 'stale' END AS state FROM anchors LEFT JOIN symbols s ON s.id = symbol_id")
def anchor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, symbols, _ = anchored(spark, sf_dir)
    return M.anchor_states(anchors, symbols)


@query(f"WITH {ANCHORS_SQL}, m AS (SELECT fact_id, CASE WHEN t.hash = content_hash THEN new_id ELSE symbol_id END AS symbol_id, content_hash FROM anchors LEFT JOIN renames ON old_id = symbol_id LEFT JOIN symbols t ON t.id = new_id), s AS (SELECT fact_id, bool_or(s.id IS NULL) AS gone, bool_or(s.hash <> content_hash) AS old FROM m LEFT JOIN symbols s ON s.id = symbol_id GROUP BY 1) SELECT fact_id, CASE WHEN gone THEN 'orphaned' WHEN old THEN 'stale' WHEN fact_id % 31 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM s")
def refresh_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, symbols, renames = anchored(spark, sf_dir)
    facts = anchors.select("fact_id").distinct().withColumn("freshness", F.when(F.col("fact_id") % 31 == 0, "stale").otherwise("fresh"))
    return M.refresh(facts, anchors, symbols, renames)[0]


@query(f"WITH {ANCHORS_SQL.split(', symbols AS')[0]}, before AS (SELECT p_partkey AS id, sha256(p_partkey::VARCHAR) AS h FROM part), after AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END AS id, CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE sha256(p_partkey::VARCHAR) END AS h FROM part WHERE p_partkey % 19 <> 0), m AS (SELECT fact_id, CASE WHEN t.id IS NOT NULL THEN t.id ELSE symbol_id END AS symbol_id, sha256(symbol_id::VARCHAR) AS h FROM anchors LEFT JOIN after t ON t.id = symbol_id + 1000000000 AND t.h = sha256(symbol_id::VARCHAR)), s AS (SELECT fact_id, bool_or(a.id IS NULL) AS gone, bool_or(a.h <> m.h) AS old FROM m LEFT JOIN after a ON a.id = symbol_id GROUP BY 1) SELECT fact_id, CASE WHEN gone THEN 'orphaned' WHEN old THEN 'stale' ELSE 'fresh' END AS freshness FROM s")
def refresh_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after a snapshot in which parts were renamed, edited and deleted; renames are told from the snapshots."""
    anchors, *_ = anchored(spark, sf_dir)
    k = F.col("p_partkey").cast("long")
    part, digest = table(spark, sf_dir, "part"), F.sha2(k.cast("string"), 256)
    before = part.select(k.alias("id"), digest.alias("content_hash"))
    after = part.filter(k % 19 != 0).select(F.when(k % 13 == 0, k + 1_000_000_000).otherwise(k).alias("id"), F.when(k % 17 == 0, "x").otherwise(digest).alias("content_hash"))
    facts = anchors.select("fact_id").distinct().withColumn("freshness", F.lit("fresh"))
    hashed = anchors.select("fact_id", F.col("symbol_id").cast("long").alias("symbol_id"), F.sha2(F.col("symbol_id").cast("string"), 256).alias("content_hash"))
    return M.refresh_after(facts, hashed, before, after)[0]


@query("SELECT a.s_suppkey AS fact_id, b.s_suppkey AS other_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 3 <> b.s_suppkey % 3")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fact_id"), F.col("s_nationkey").cast("string").alias("subject"), (F.col("s_suppkey") % 3).cast("string").alias("text"))
    return M.contradictions(s)


@query("SELECT s_nationkey::VARCHAR AS subject, count(DISTINCT s_suppkey % 3) AS texts, count(*) AS facts FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 3) > 1")
def contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fact_id"), F.col("s_nationkey").cast("string").alias("subject"), (F.col("s_suppkey") % 3).cast("string").alias("text"))
    return M.contested(s)


@query("SELECT c_nationkey AS subject, c_custkey AS fact_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 0 END DESC, c_custkey % 7 DESC, c_custkey % 5 DESC, c_custkey DESC) = 1")
def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    facts = c.select(F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("fact_id"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 7).alias("valid_from"), (F.col("c_custkey") % 5).alias("recorded_at"), F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("confidence"))
    return M.preferred(facts, {"BUILDING": 3, "MACHINERY": 2, "FURNITURE": 1})


TIMELINE_SQL = f"""{LOG_SQL}, c AS (SELECT fact_id, seq, payload, recorded_at, max(date_trunc('day', recorded_at)) OVER (PARTITION BY fact_id ORDER BY seq) AS valid_from FROM log),
a AS (SELECT *, lead(recorded_at) OVER w AS nxt, lead(valid_from) OVER w AS nv FROM c WINDOW w AS (PARTITION BY fact_id ORDER BY seq)),
timeline AS (SELECT fact_id, payload, valid_from, NULL::TIMESTAMP AS valid_to, recorded_at AS tx_from, nxt AS tx_to FROM a UNION ALL SELECT fact_id, payload, valid_from, nv, nxt, NULL FROM a WHERE nv > valid_from)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("fact_id").orderBy("seq")
    return log(spark, sf_dir).withColumn("valid_from", F.max(F.date_trunc("day", "recorded_at").cast("timestamp_ntz")).over(along))


@query(f"WITH {TIMELINE_SQL} SELECT * FROM timeline")
def timeline_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.timeline_simple(corrections(spark, sf_dir))


@query(f"WITH {TIMELINE_SQL} SELECT fact_id, payload FROM timeline WHERE valid_from <= m AND (valid_to IS NULL OR m < valid_to) AND tx_from <= m AND (tx_to IS NULL OR m < tx_to)".replace("FROM timeline WHERE", "FROM timeline, (SELECT min(ts) + INTERVAL 10 DAY AS m FROM events) WHERE"))
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed ten days after the first event, about that time."""
    point = table(spark, sf_dir, "events").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("m")).first()[0]
    return M.as_of(M.timeline_simple(corrections(spark, sf_dir)), F.lit(point).cast("timestamp_ntz"), F.lit(point).cast("timestamp_ntz")).select("fact_id", "payload")


@query()
def timeline_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any corrections, invalidations among them: each fact's operations folded in order."""
    rows = log(spark, sf_dir)
    timed = M.monotone(rows.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), ["fact_id"], ["seq"], "recorded_at")
    return M.timeline(timed.withColumn("valid_from", F.date_trunc("day", "recorded_at")).withColumn("valid_to", F.lit(None).cast("timestamp")))


@query("SELECT p_brand, string_agg(p_name, ' ' ORDER BY p_partkey) AS text, min(p_retailprice) AS confidence, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1 HAVING count(*) >= 2")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    facts = part.select("p_brand", F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("confidence"), F.when(F.col("p_size") > 25, "fresh").otherwise("stale").alias("freshness"))
    return M.summaries(facts, "p_brand").select("p_brand", "text", "confidence", F.size("derived_from").cast("long").alias("n"))


RECALL_CORPUS = "corpus AS (SELECT doc_id AS id, source AS path, source AS signature, lang AS docstring, text AS body FROM documents)"
ASKED = "SELECT * FROM (VALUES (1, 'worthless idiot'), (2, 'license of src3')) v(query_id, text)"


@query(f"WITH {bm25f_sql(ASKED, k=1_000_000_000, corpus=RECALL_CORPUS)}, f AS (SELECT query_id, id AS fact_id, ['fresh', 'stale', 'orphaned'][1 + id % 3] AS freshness, score, id % 3 AS o FROM ranked) SELECT query_id, fact_id, freshness, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o, round(score, 9) DESC, fact_id) AS place FROM f")
def recall_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that match each of two questions, fresh ones first."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.select(F.col("doc_id").alias("fact_id"), F.col("source").alias("anchors_text"), F.col("lang").alias("subject"), "text", F.element_at(F.array(*map(F.lit, ("fresh", "stale", "orphaned"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("freshness"), F.lit(1.0).alias("confidence"))
    asked = spark.sql("SELECT * FROM VALUES (1, 'worthless idiot'), (2, 'license of src3') AS t(query_id, query)")
    return M.rank_recall(facts, asked).select("query_id", "fact_id", "freshness", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))
