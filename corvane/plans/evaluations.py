"""Queries for evaluation analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.operators import evaluation as E
from corvane.operators import lexical
from corvane.plans.adapters import corpus
from corvane.plans.registry import query, table
from corvane.plans.retrieval import ANSWER_SQL, FIELDS, bm25f_sql
from corvane.session import small, spread

SHARED = 8
GRAMS = "SELECT DISTINCT {0} AS id, array_to_string(w[i:i + " + str(SHARED - 1) + "], ' ') AS gram FROM (SELECT {0}, w, unnest(range(1, len(w) - " + str(SHARED - 2) + ")) AS i FROM (SELECT {0}, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM {1}))"
GOLD_SQL = f"gold AS (SELECT DISTINCT a.id AS query_id, b.id AS id FROM ({GRAMS.format('item_id', 'benchmark')}) a JOIN ({GRAMS.format('doc_id', 'documents')}) b USING (gram))"


def grams(df: DataFrame, id: str) -> DataFrame:
    """(id, gram): hashes of the distinct runs of SHARED words."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    words = df.select(F.col(id).alias("id"), w.alias("w")).filter(F.size("w") >= SHARED)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (SHARED - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHARED), " "))))
    return words.select("id", F.explode(runs).alias("gram"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage of SHARED words, from anywhere in it, with an item."""
    items = grams(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("id", "query_id")
    docs = grams(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return docs.join(small(items), "gram").select("query_id", "id").distinct()


@query(
    f"WITH {bm25f_sql('SELECT item_id AS query_id, text FROM benchmark', k=10)}, {GOLD_SQL}, n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT query_id, count(*) AS h FROM ranked JOIN gold USING (query_id, id) GROUP BY 1) SELECT item_id AS query_id, round(CASE WHEN n > 0 THEN coalesce(h, 0) / n END, 6) AS recall FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN h ON h.query_id = item_id".replace(
        "), n AS (SELECT query_id", "), golds AS (SELECT query_id"
    ).replace("LEFT JOIN n ON n.query_id", "LEFT JOIN golds n ON n.query_id")
)
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", FIELDS, "item_id", "text", 10)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    recall = E.recall_at_k(found.select("query_id", F.col("id").alias("item"), "rank"), gold(spark, sf_dir).withColumnRenamed("id", "item"), 10)
    return items.join(recall, "query_id", "left").select("query_id", F.round("recall", 6).alias("recall"))


@query(
    """WITH first AS (SELECT l_orderkey AS query_id, l_suppkey AS item, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, item) AS place FROM first QUALIFY place <= 2),
gold AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R')
SELECT q.query_id, round(CASE WHEN n > 0 THEN coalesce(h, 0) / n END, 6) AS recall FROM (SELECT DISTINCT query_id FROM first) q
LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS h FROM best JOIN gold USING (query_id, item) GROUP BY 1) USING (query_id)"""
)
def file_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, suppliers as files by first occurrence, returned lines as gold."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    return E.recall_at_k(lines, lines.filter("l_returnflag = 'R'"), 2).withColumn("recall", F.round("recall", 6))


@query(
    """WITH spans AS (SELECT p_brand AS path, p_partkey AS id, (p_partkey * 7) % 400 AS s, (p_partkey * 7) % 400 + p_size AS e FROM part),
points AS (SELECT s_suppkey AS point_id, 'Brand#' || (11 + s_suppkey % 5) AS path, (s_suppkey * 13) % 420 AS line FROM supplier)
SELECT point_id, id FROM points JOIN spans USING (path) WHERE line BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY e - s, id) = 1"""
)
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: the smallest span that holds each changed line."""
    spans = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7) % 400).alias("start"), ((F.col("p_partkey") * 7) % 400 + F.col("p_size")).alias("end"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("path"), ((F.col("s_suppkey") * 13) % 420).alias("line"))
    return E.innermost(spans, points)


STATES = "CASE WHEN {0} % 3 = 0 THEN 'stale' WHEN {0} % 5 = 0 THEN 'orphaned' ELSE 'fresh' END"


@query(
    f"""WITH r AS (SELECT {STATES.format('o_custkey')} AS e, {STATES.format('o_orderkey')} AS o FROM orders),
c AS (SELECT count(*) FILTER (e <> 'fresh' AND o <> 'fresh') AS tp, count(*) FILTER (e = 'fresh' AND o <> 'fresh') AS fp, count(*) FILTER (e = 'fresh' AND o = 'fresh') AS tn, count(*) FILTER (e <> 'fresh' AND o = 'fresh') AS fn FROM r)
SELECT tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
)
def stale_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr(STATES.format("o_custkey")).alias("expected"), F.expr(STATES.format("o_orderkey")).alias("observed"))
    return E.confusion(rows).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("SELECT item_id, CASE WHEN concat('0x', substr(sha256(item_id::VARCHAR), 1, 16))::UBIGINT % 5 = 0 THEN 'validation' ELSE 'test' END AS split, item_id || '-' || substr(sha256(item_id || chr(0) || text), 1, 16) AS evaluation_id FROM benchmark")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select("item_id", E.split(id).alias("split"), E.evaluation_id(id, id, F.col("text")).alias("evaluation_id"))


@query("WITH l AS (SELECT event_type AS method, user_id % 4 AS k, CASE WHEN value > 5 THEN value END AS v FROM events) SELECT method, k, round(avg(v), 6) AS mean, count(v) AS defined, count(*) AS rows FROM l GROUP BY ALL")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("k"), F.when(F.col("value") > 5, F.col("value")).alias("v"))
    return E.summary(long, ["method", "k"], "v").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return q.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per_user = events.groupBy("event_type", "user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return E.paired_bootstrap(per_user, ["event_type"])


@query("WITH e AS (SELECT user_id, event_type, last(event_type ORDER BY ts, event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM events) SELECT user_id, z AS last_kind, count(*) FILTER (event_type = 'error') AS failures FROM e GROUP BY ALL HAVING z = 'error'".replace("last(event_type ORDER BY ts, event_id)", "last_value(event_type)"))
def unresolved_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event is a failure."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return last.filter("last_kind = 'error'")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS session, count(*) AS turns FROM conversations GROUP BY 1")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("session"), F.count(F.lit(1)).alias("turns"))


@query("SELECT g AS group_name, count(*) AS n, round(avg(length(text)), 6) AS mean FROM (SELECT text, unnest(CASE WHEN text LIKE '%not%' THEN ['all', role, 'abstention'] ELSE ['all', role] END) AS g FROM conversations) GROUP BY 1")
def overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total, each role, and a group that overlaps them."""
    groups = F.when(F.contains("text", F.lit("not")), F.array(F.lit("all"), F.col("role"), F.lit("abstention"))).otherwise(F.array(F.lit("all"), F.col("role")))
    return table(spark, sf_dir, "conversations").select("text", F.explode(groups).alias("group_name")).groupBy("group_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean"))


@query("SELECT vec_id, label FROM embeddings ORDER BY sha256(vec_id::VARCHAR), vec_id LIMIT 25")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the feature here: the 25 rows least by hash."""
    return E.sample_by_hash(table(spark, sf_dir, "embeddings"), "vec_id", 25).select("vec_id", "label")


LINES_SQL = "lines AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)"


@query(f"WITH {LINES_SQL}, added AS (SELECT DISTINCT item_id AS task_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) SELECT DISTINCT task_id, line FROM added WHERE length(line) >= 20 AND line IN (SELECT line FROM lines WHERE doc_id % 2 = 0) AND line NOT IN (SELECT line FROM lines WHERE doc_id % 2 = 1)")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda df, id: df.select(id, F.explode(F.split("text", "\n")).alias("line"))
    docs = lines(table(spark, sf_dir, "documents"), "doc_id")
    return E.leaked(lines(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("item_id", "task_id"), docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"))


@query("WITH m AS (SELECT o_orderkey AS pos, o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE lag(o_orderkey) OVER (ORDER BY o_orderkey) END AS parent, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM orders) SELECT pos, id, parent FROM m WHERE b IS NOT NULL AND parent IS DISTINCT FROM b")
def manifest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"))
    parent = F.when(F.col("id") % 50 == 0, 0).when(F.col("id") > 0, F.col("id") - 1)
    return E.chain_breaks(orders.withColumn("parent", parent))


@query("WITH n AS (SELECT ceil(count(*) / 7.0)::BIGINT AS size FROM orders) SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // size AS shard FROM orders, n")
def contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shards(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("WITH r AS (SELECT source, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT source, doc_id, used::BIGINT AS used FROM r WHERE used <= 20000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return E.truncate_to_budget(docs, ["source"], ["doc_id"], "bytes", 20_000).select("source", "doc_id", "used")


@query(
    """WITH b AS (SELECT unnest([60, 600, 6000])::INT AS budget), c AS (SELECT p_brand AS query_id, p_partkey AS id, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS used, p_size <= 4 AND p_partkey % 9 = 0 AS gold FROM part),
n AS (SELECT query_id, count(*) FILTER (gold) AS n FROM c GROUP BY 1), r AS (SELECT query_id, budget, CASE WHEN n > 0 THEN count(*) FILTER (gold) / n END AS recall FROM c JOIN b ON used <= budget JOIN n USING (query_id) GROUP BY query_id, budget, n)
SELECT query_id, budget, round(recall, 6) AS recall, min(CASE WHEN recall = 1 THEN budget END) OVER (PARTITION BY query_id) AS covering FROM r"""
)
def budget_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand packed in order of size at three budgets, some of the small ones gold; and the least budget that covers all gold."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), "p_size")
    gold = part.filter("p_size <= 4 and id % 9 = 0").select("query_id", "id")
    packed = None
    for budget in (60, 600, 6000):
        one = E.truncate_to_budget(part, ["query_id"], ["p_size", "id"], "p_size", budget).withColumn("budget", F.lit(budget))
        packed = one if packed is None else packed.unionByName(one)
    recalls = E.packed_recall(packed, gold, ["query_id", "budget"])
    return recalls.join(E.covering_budget(recalls).withColumnRenamed("budget", "covering"), "query_id").select("query_id", "budget", F.round("recall", 6).alias("recall"), "covering")


@query(
    "WITH first AS (SELECT l_orderkey AS query_id, l_suppkey AS item, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL), best AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, item) <= 2), gold AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R') SELECT DISTINCT query_id FROM gold WHERE query_id NOT IN (SELECT query_id FROM best JOIN gold USING (query_id, item))"
)
def miss_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of whose returned lines none is among the first two suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    return E.misses(E.recall_at_k(lines, lines.filter("l_returnflag = 'R'"), 2)).select("query_id")


SESSIONS = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"
SESSION_CORPUS = f"corpus AS (SELECT conv_id AS id, '' AS path, '' AS signature, '' AS docstring, text AS body FROM ({SESSIONS}))"


@query(f"WITH {bm25f_sql('SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0', k=1_000_000_000, corpus=SESSION_CORPUS)}, past AS (SELECT * FROM ranked WHERE id <= query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5), q AS (SELECT conv_id AS query_id FROM conversations WHERE turn = 0) SELECT query_id, coalesce(max((id = query_id)::INT), 0)::DOUBLE AS recall, count(id) = 0 AS abstained FROM q LEFT JOIN past USING (query_id) GROUP BY 1")
def session_recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turn asks for the conversation among those that were before it, itself included; later ones are left out.

    What ranks below the conversation itself changes neither its recall nor whether anything is found."""
    turns = table(spark, sf_dir, "conversations")
    sessions = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("body"))
    docs = sessions.select("conv_id", F.lit("").alias("signature"), F.lit("").alias("docstring"), "body")
    asked = turns.filter("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    past = lexical.search_own(docs, asked, "conv_id", FIELDS, "query_id", "text", 5).select("query_id", F.col("id").alias("item"), "rank")
    gold = asked.select("query_id", F.col("query_id").alias("item"))
    return E.session_recall(past, gold).select("query_id", "recall", "abstained")


@query(
    f"""WITH q AS (SELECT conv_id || CASE WHEN conv_id % 7 = 0 THEN '_abs' ELSE '' END AS question_id, 'type' || conv_id % 3 AS question_type, split_part(text, ' ', 2) AS answer FROM conversations WHERE turn = 0),
h AS (SELECT conv_id || CASE WHEN conv_id % 7 = 0 THEN '_abs' ELSE '' END AS question_id, text || CASE WHEN conv_id % 2 = 0 THEN ' I do not know' ELSE '' END AS hypothesis FROM conversations WHERE turn = 1),
g AS (SELECT CASE WHEN ends_with(question_id, '_abs') THEN contains(hypothesis, 'not know') ELSE {ANSWER_SQL.format('answer')} <> '' AND contains({ANSWER_SQL.format('hypothesis')}, {ANSWER_SQL.format('answer')}) END AS good,
  unnest(CASE WHEN ends_with(question_id, '_abs') THEN ['all', question_type, 'abstention'] ELSE ['all', question_type] END) AS group_name FROM q JOIN h USING (question_id))
SELECT group_name, count(*) AS n, round(avg(good::INT), 6) AS accuracy FROM g GROUP BY 1"""
)
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's second turn as an answer that should hold the second word of its first."""
    turns = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    id = F.concat(k.cast("string"), F.when(k % 7 == 0, "_abs").otherwise("")).alias("question_id")
    questions = turns.filter("turn = 0").select(id, F.concat(F.lit("type"), (k % 3).cast("string")).alias("question_type"), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")).alias("answer"))
    hypotheses = turns.filter("turn = 1").select(id, F.concat("text", F.when(k % 2 == 0, " I do not know").otherwise("")).alias("hypothesis"))
    return E.answer_accuracy(questions, hypotheses).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_type AS condition, sum((value > 5)::INT)::BIGINT AS solved, count(*) AS tasks FROM events GROUP BY 1")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.agent_summary(table(spark, sf_dir, "events").select(F.col("event_id").alias("task"), F.col("event_type").alias("condition"), F.coalesce(F.col("value") > 5, F.lit(False)).alias("passed")))
