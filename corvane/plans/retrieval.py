"""Queries for text, lexical, vector and fused retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.functions import text as T
from corvane.operators import encode, fusion, graph, lexical, vector
from corvane.plans.adapters import EDGES_SQL, corpus, edges, nodes
from corvane.plans.registry import query, table
from corvane.session import cut, ensure_checkpoint_dir, spread
from corvane.sources import files

FIELDS = ["signature", "docstring", "body"]
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS["python"].split())


def sql_tokens(text: str) -> str:
    parts = rf"regexp_extract_all(regexp_replace(replace({text}, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[0-9]+|\pL+')"
    return f"list_transform({parts}, lambda x: replace(lower(x), 'ß', 'ss'))"


def sql_code_tokens(text: str) -> str:
    compound = f"list_transform(list_filter(regexp_extract_all({text}, '[\\pL\\pN_]+'), lambda w: contains(w, '_') OR len({sql_tokens('w')}) > 1), lambda x: replace(lower(x), 'ß', 'ss'))"
    signs = f"regexp_extract_all({text}, '==|!=|<=|>=|:=|\\*\\*|//|->|[+*/%<>=!-]')"
    return f"list_concat(list_filter(list_concat({sql_tokens(text)}, {compound}), lambda t: t NOT IN ({STOP})), {signs})"


CORPUS_SQL = "corpus AS (SELECT doc_id AS id, source AS path, split_part(text, chr(10), 1) AS signature, lang AS docstring, text AS body FROM documents)"


def bm25f_sql(queries: str, keep: str = "true", k: int = 10, weights: tuple[float, float, float] = (3.0, 2.0, 1.0), corpus: str = CORPUS_SQL) -> str:
    """CTEs up to ranked(query_id, id, score, rank)."""
    return f"""
{corpus},
queries AS ({queries}),
fields AS (
  SELECT id, 'signature' AS field, {weights[0]}::DOUBLE AS w, {sql_code_tokens('signature')} AS tokens FROM corpus WHERE {keep}
  UNION ALL SELECT id, 'docstring', {weights[1]}, {sql_code_tokens('docstring')} FROM corpus WHERE {keep}
  UNION ALL SELECT id, 'body', {weights[2]}, {sql_code_tokens('body')} FROM corpus WHERE {keep}
),
n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM fields),
averages AS (SELECT field, sum(len(tokens)) / (SELECT n FROM n) AS average FROM fields GROUP BY field),
wanted AS (SELECT DISTINCT query_id, unnest({sql_code_tokens('text')}) AS term FROM queries),
posts AS (
  SELECT id, field, w, length, term, count(*) AS tf
  FROM (SELECT id, field, w, len(tokens) AS length, unnest(tokens) AS term FROM fields)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
df AS (SELECT term, count(DISTINCT id) AS df FROM posts GROUP BY term),
wtf AS (
  SELECT p.term, p.id, sum(w * tf / (1 - 0.75 + 0.75 * length / coalesce(nullif(average, 0), 1))) AS wtf
  FROM posts p JOIN averages a USING (field) GROUP BY p.term, p.id
),
scores AS (
  SELECT q.query_id, t.id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2)) AS score
  FROM wtf t JOIN df USING (term) JOIN wanted q USING (term), n WHERE wtf <> 0 GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores QUALIFY rank <= {k})
"""


@query(f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, sha256(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(f"SELECT doc_id, len({sql_code_tokens('text')})::BIGINT AS n_tokens, sha256(array_to_string({sql_code_tokens('text')}, ' ')) AS digest FROM documents")
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.code_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(r"SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS normalized FROM benchmark")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items hold no letters that the compatible form changes and the canonical one doesn't; a test has some."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_query("text").alias("normalized"))


@query(
    "SELECT doc_id, (SELECT sum((length(f) - length(replace(f, w, ''))) // length(w)) FROM (SELECT replace(lower(text), 'ß', 'ss') AS f), (VALUES ('the'), ('and'), ('est')) v(w))::BIGINT AS score FROM documents"
)
def grep_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("the", "and", "est")))
    return table(spark, sf_dir, "documents").select("doc_id", T.grep_score(F.col("text"), words).alias("score"))


ANSWER_SQL = r"array_to_string(list_filter(string_split(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"SELECT conv_id, turn, {ANSWER_SQL.format('text')} AS normalized FROM conversations")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("normalized"))


@query(f"WITH {bm25f_sql('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked")
def bm25f_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the ten best documents of each benchmark item."""
    found = lexical.search(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", FIELDS, "item_id", "text", 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {bm25f_sql('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship from a persisted index: built, loaded again, and read by the buckets of the queries' terms."""
    folder = f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    lexical.PostingsIndex.build(corpus(spark, sf_dir), "doc_id", FIELDS, folder)
    return _found(lexical.PostingsIndex(spark, folder, FIELDS).search(table(spark, sf_dir, "benchmark"), "item_id", "text", 10))


@query(f"WITH {bm25f_sql('SELECT item_id AS query_id, text FROM benchmark', keep='id % 7 <> 0', k=10)} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked")
def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half of the documents, some with other texts, then changed to all but a seventh; equal to a fresh one."""
    docs = corpus(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    index = lexical.PostingsIndex.build(docs.filter("doc_id % 2 = 0").withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.lit("other text")).otherwise(F.col("body"))), "doc_id", FIELDS, folder)
    changed = docs.filter("(doc_id % 2 = 1 or doc_id % 3 = 0) and doc_id % 7 <> 0")
    index.update(changed, "doc_id", docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    return _found(index.search(table(spark, sf_dir, "benchmark"), "item_id", "text", 10))


@query(f"WITH {bm25f_sql('SELECT item_id AS query_id, text FROM benchmark', keep='id % 7 <> 0', k=5)} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked")
def bm25f_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the documents is taken out of the index; statistics are those of the rest."""
    docs = corpus(spark, sf_dir)
    gone = docs.filter("doc_id % 7 = 0")
    left = docs.join(gone.select("doc_id"), "doc_id", "left_anti")
    found = lexical.search(left, table(spark, sf_dir, "benchmark"), "doc_id", FIELDS, "item_id", "text", 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {CORPUS_SQL}, t AS (SELECT id, {sql_code_tokens('body')} AS tokens FROM corpus WHERE length(body) > 0),
p AS (SELECT id, length, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(tokens) AS length, unnest(tokens) AS term FROM t) WHERE term IN ('the', 'und', 'que') GROUP BY ALL),
d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term), s AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS average FROM t)
SELECT id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)), 6) AS score FROM p JOIN d USING (term), s"""
)
def bm25_single_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).filter(F.length("body") > 0)
    index = lexical.counted(docs, "doc_id", ["body"])
    terms = spark.sql("SELECT * FROM VALUES ('the'), ('und'), ('que') AS t(term)")
    posts = lexical.postings(index, ["body"], terms)
    joined = posts.join(lexical.document_frequency(posts), "term").crossJoin(F.broadcast(lexical.statistics(index, ["body"])))
    score = lexical.bm25(F.col("tf_body").cast("double"), F.col("df").cast("double"), F.col("n"), F.col("len_body"), F.col("avg_body"))
    return joined.select("id", "term", F.round(score, 6).alias("score"))


@query(
    f"""WITH {CORPUS_SQL}, f AS (SELECT id, len({sql_code_tokens('signature')}) AS s, len({sql_code_tokens('docstring')}) AS d, len({sql_code_tokens('body')}) AS b FROM corpus)
SELECT count(*) AS n, round(sum(s) / count(*), 6) AS avg_signature, round(sum(d) / count(*), 6) AS avg_docstring, round(sum(b) / count(*), 6) AS avg_body FROM f"""
)
def lexical_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lexical.statistics(lexical.counted(corpus(spark, sf_dir), "doc_id", FIELDS), FIELDS)
    return stats.select("n", *(F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in FIELDS))


@query(
    f"""WITH {CORPUS_SQL}, t AS (SELECT DISTINCT id, unnest({sql_code_tokens('signature')}) AS term FROM corpus UNION SELECT id, unnest({sql_code_tokens('docstring')}) FROM corpus UNION SELECT id, unnest({sql_code_tokens('body')}) FROM corpus)
SELECT term, count(*) AS df FROM t GROUP BY term"""
)
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.counted(corpus(spark, sf_dir), "doc_id", FIELDS)
    return lexical.document_frequency(lexical.postings(index, FIELDS))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'there') OR contains(lower(source), 'there') ORDER BY source, doc_id")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-folded substring of name or qualified name."""
    docs = table(spark, sf_dir, "documents")
    hit = F.contains(F.lower("text"), F.lit("there")) | F.contains(F.lower("source"), F.lit("there"))
    return docs.filter(hit).select("doc_id", "source").orderBy("source", "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.normalize(vector.as_doubles(F.col("embedding"))).alias("v"), "label")


VECTORS_SQL = "raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), vectors AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM raw)"
KNN_SQL = VECTORS_SQL + ", knn AS (SELECT q.id AS query_id, t.id, list_dot_product(q.v, t.v) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, t.v), 9) DESC, t.id) AS rank FROM vectors q JOIN vectors t ON q.id <> t.id WHERE q.id % 100 = 0 QUALIFY rank <= 10)"


@query(f"WITH {KNN_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each whose id is divisible by 100."""
    v = vectors(spark, sf_dir)
    found = vector.exact_knn(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {KNN_SQL} SELECT k.query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_10 FROM knn k JOIN vectors a ON a.id = k.query_id JOIN vectors b ON b.id = k.id GROUP BY k.query_id")
def knn_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = vector.exact_knn(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), 10)
    labels = v.select("id", "label")
    joined = found.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return joined.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("precision_at_10"))


@query(f"WITH {VECTORS_SQL} SELECT a.id AS id, round(greatest(0, least(2, 1 - list_dot_product(a.v, b.v))), 6) AS distance FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(after, "id").select("id", F.round(vector.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


def _recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    hits = found.select("query_id", "id").join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hits / max(1, exact.count())


@query("SELECT count(*) AS indexed, count(*) FILTER (vec_id % 100 = 0) AS queries, true AS recall_reached FROM embeddings")
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted file: centroids from a bounded sample, every row indexed, lists re-ranked exactly; its recall at ten against brute force must reach 0.9."""
    v = cut(vectors(spark, sf_dir).select("id", "v"))
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v")
    ivf = vector.InvertedFile.fit(v)
    index = cut(ivf.index(v))
    recall = _recall(ivf.search(index, asked, 10), vector.exact_knn(v, asked, 10))
    return index.agg(F.count(F.lit(1)).alias("indexed")).withColumn("queries", F.lit(asked.count())).withColumn("recall_reached", F.lit(recall >= 0.9))


@query("SELECT count(*) FILTER (vec_id % 9 <> 0) AS indexed, true AS recall_reached, true AS same_as_kept FROM embeddings")
def ann_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index with a ninth of its rows removed and another ninth replaced, saved, loaded and checked."""
    v = cut(vectors(spark, sf_dir).select("id", "v"))
    ivf = vector.InvertedFile.fit(v)
    kept = ivf.remove(ivf.index(v), v.filter("id % 9 = 0"))
    kept = cut(ivf.update(kept, v.filter("id % 9 = 1")))
    folder = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    ivf.save(kept, folder)
    loaded, index = vector.InvertedFile.load(spark, folder)
    asked, left = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), v.filter("id % 9 <> 0")
    found = cut(loaded.search(index, asked, 10))
    same = found.select("query_id", "id").exceptAll(ivf.search(kept, asked, 10).select("query_id", "id")).isEmpty()
    recall = _recall(found, vector.exact_knn(left, asked, 10))
    return index.agg(F.count(F.lit(1)).alias("indexed")).withColumn("recall_reached", F.lit(recall >= 0.9)).withColumn("same_as_kept", F.lit(same))


@query(
    f"""WITH {VECTORS_SQL}, pairs AS (SELECT a.id, list_dot_product(a.v, b.v) AS c, [a.id % 5, a.id % 7] AS x, [b.id % 5, b.id % 7] AS y FROM vectors a JOIN vectors b ON b.id = a.id + 1),
s AS (SELECT id, c, list_distinct(x) AS x, list_distinct(y) AS y FROM pairs)
SELECT id, round(0.7 * greatest(0, c) + 0.3 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS related FROM s"""
)
def relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    anchors = lambda c: F.array(c % 5, c % 7)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    related = vector.relatedness(vector.dot(F.col("v"), F.col("w")), anchors(F.col("id")), anchors(F.col("id") + 1))
    return v.join(after, "id").select("id", F.round(related, 6).alias("related"))


RANKINGS_SQL = """
lists AS (
  SELECT p_brand AS query_id, 'price' AS list, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, 1.0::DOUBLE AS weight FROM part
  UNION ALL SELECT p_brand, 'size', p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey), 0.5 FROM part
), fused AS (SELECT query_id, id, sum(weight / (60.0 + rank)) AS score FROM lists WHERE rank <= 50 GROUP BY ALL)"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each brand's parts: by price and by size, the fifty best."""
    part = table(spark, sf_dir, "part")
    one = lambda name, by, w: part.select(F.col("p_brand").alias("query_id"), F.lit(name).alias("list"), F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(by), "p_partkey")).alias("rank"), F.lit(w).alias("weight"))
    return one("price", "p_retailprice", 1.0).unionByName(one("size", "p_size", 0.5)).filter("rank <= 50")


@query(f"WITH {RANKINGS_SQL} SELECT query_id, id, round(score, 6) AS score FROM fused")
def reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(rankings(spark, sf_dir), by=["query_id"]).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {RANKINGS_SQL}, grid AS (SELECT a.w AS w_lexical, b.w AS w_vector FROM (VALUES (0.0), (0.5), (1.0)) a(w), (VALUES (0.5), (1.0)) b(w)),
r AS (SELECT p_brand AS query_id, p_partkey AS id, max(CASE WHEN list = 'price' THEN rank END) AS r_lexical, max(CASE WHEN list = 'size' THEN rank END) AS r_vector, p_partkey % 9 = 0 AS is_gold FROM part JOIN lists ON lists.id = p_partkey AND rank <= 50 GROUP BY ALL),
s AS (SELECT w_lexical, w_vector, query_id, is_gold, row_number() OVER (PARTITION BY w_lexical, w_vector, query_id ORDER BY round(coalesce(w_lexical / (60 + r_lexical), 0) + coalesce(w_vector / (60 + r_vector), 0), 12) DESC, id) AS place FROM r, grid),
m AS (SELECT w_lexical, w_vector, query_id, min(CASE WHEN is_gold THEN place END) AS place FROM s GROUP BY ALL)
SELECT w_lexical::DOUBLE AS w_lexical, w_vector::DOUBLE AS w_vector, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM m GROUP BY ALL"""
)
def fusion_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = rankings(spark, sf_dir)
    ranks = lists.groupBy("query_id", "id").agg(F.max(F.when(F.col("list") == "price", F.col("rank"))).alias("r_lexical"), F.max(F.when(F.col("list") == "size", F.col("rank"))).alias("r_vector")).withColumn("is_gold", F.col("id") % 9 == 0)
    grid = spark.sql("SELECT cast(a as double) w_lexical, cast(b as double) w_vector FROM VALUES (0.0), (0.5), (1.0) AS x(a), VALUES (0.5), (1.0) AS y(b)")
    return fusion.tune_weights(ranks, grid).withColumn("mrr", F.round("mrr", 6))


NODES_SQL = EDGES_SQL + ", nodes AS (SELECT source AS id FROM edges UNION SELECT target FROM edges)"
GRAPH_SQL = f"""{NODES_SQL},
both_ways AS (SELECT source, target, kind, confidence FROM edges UNION ALL SELECT target, source, kind, confidence * 0.5 FROM edges),
graph AS (SELECT source AS src, target AS dst, sum(CASE kind WHEN 'calls' THEN 1.0 WHEN 'imports' THEN 0.5 WHEN 'contains' THEN 0.3 ELSE 0.1 END * confidence) AS w FROM both_ways GROUP BY ALL),
steps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM graph)"""
SEEDS_SQL = "seeds AS (SELECT 1::BIGINT AS query_id, 'n3' AS id, 2.0::DOUBLE AS score UNION ALL SELECT 1, 's1', 1.0 UNION ALL SELECT 2, 'r0', 1.0)"


def ranking_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf_dir)
    return nodes(e), graph.adjacency(nodes(e), graph.with_reverse(e))


def seeds(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT cast(q as bigint) query_id, id, cast(s as double) score FROM VALUES (1, 'n3', 2.0), (1, 's1', 1.0), (2, 'r0', 1.0) AS t(q, id, s)")


@query(f"WITH {GRAPH_SQL} SELECT src, dst, round(w, 6) AS w FROM graph")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking_graph(spark, sf_dir)[1].withColumn("w", F.round("w", 6))


@query(f"WITH {GRAPH_SQL} SELECT src, dst, round(p, 6) AS p FROM steps")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitions(ranking_graph(spark, sf_dir)[1]).withColumn("p", F.round("p", 6))


def ppr_sql(rounds: int) -> str:
    out = f"{GRAPH_SQL}, {SEEDS_SQL}, r AS (SELECT query_id, id, score / sum(score) OVER (PARTITION BY query_id) AS r FROM seeds), p0 AS (SELECT query_id, id, r AS score FROM r)"
    for i in range(rounds):
        out += f""", d{i} AS (SELECT query_id, sum(score) AS d FROM p{i} WHERE id NOT IN (SELECT src FROM steps) GROUP BY query_id),
p{i + 1} AS (SELECT query_id, id, sum(score) AS score FROM (
  SELECT r.query_id, r.id, (0.15 + 0.85 * coalesce(d, 0)) * r AS score FROM r LEFT JOIN d{i} USING (query_id)
  UNION ALL SELECT query_id, dst, 0.85 * score * p FROM p{i} JOIN steps ON src = id) GROUP BY query_id, id)"""
    return out


@query(f"WITH {ppr_sql(6)} SELECT query_id, id, round(score, 6) AS score FROM p6")
def pagerank_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personalised PageRank, six rounds, two seed sets at once."""
    n, g = ranking_graph(spark, sf_dir)
    return graph.personalized_pagerank(n, g, seeds(spark), exact_rounds=6).withColumn("score", F.round("score", 6))


@query()
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g = ranking_graph(spark, sf_dir)
    return graph.personalized_pagerank(n, g, seeds(spark), tolerance=1e-7).withColumn("score", F.round("score", 6))


@query()
def pagerank_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g = ranking_graph(spark, sf_dir)
    scores, residual, converged = graph.push_pagerank(g, seeds(spark).filter("query_id = 1"), tolerance=1e-4)
    return scores.select("id", "score", F.lit(residual).alias("residual"), F.lit(converged).alias("converged"))


SEED_NODES = "SELECT 'n3' AS id UNION ALL SELECT 'n7'"


@query(f"WITH {EDGES_SQL}, s AS ({SEED_NODES}) SELECT id FROM s UNION SELECT source FROM edges JOIN s ON target = s.id WHERE kind = 'calls'")
def expand_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand_callers(spark.sql(SEED_NODES), edges(spark, sf_dir))


RETAGGED = "(SELECT source, target, CASE kind WHEN 'imports' THEN 'tests' ELSE kind END AS kind, confidence FROM edges)"


@query(f"WITH {EDGES_SQL}, s AS ({SEED_NODES}), e AS {RETAGGED} SELECT id FROM s UNION SELECT unnest([source, target]) FROM e WHERE kind IN ('tests', 'config') AND (source IN (SELECT id FROM s) OR target IN (SELECT id FROM s))")
def expand_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "imports", "tests").otherwise(F.col("kind")))
    return graph.expand_associations(spark.sql(SEED_NODES), e)


@query(f"WITH {EDGES_SQL} SELECT source, target, kind, confidence FROM edges WHERE kind IN ('calls', 'may_call') AND target IN ('n3', 'n7')")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(spark.sql(SEED_NODES), edges(spark, sf_dir), incoming=True)


@query(f"WITH {EDGES_SQL} SELECT source, target, kind, confidence FROM edges WHERE kind IN ('calls', 'may_call') AND source IN ('c3', 'c6')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(spark.sql("SELECT 'c3' AS id UNION ALL SELECT 'c6'"), edges(spark, sf_dir), incoming=False)


@query(f"WITH {EDGES_SQL} SELECT DISTINCT source, target, kind, confidence FROM edges WHERE source IN ('n3', 'n7') OR target IN ('n3', 'n7')")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(spark.sql(SEED_NODES), edges(spark, sf_dir))


def encoded_sql(name: str, source: str) -> str:
    """CTEs up to name(id, dim, x): unit vectors of the hashing encoder, without zeros."""
    digit = lambda a, n: f"concat('0x', substr(md5(t), {a}, {n}))::UBIGINT::BIGINT"
    return f"""{name}_tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({sql_tokens('text')}) AS t FROM ({source})) GROUP BY ALL),
{name}_sums AS (SELECT id, {digit(1, 4)} % {encode.HashingEncoder.DIMENSIONS} AS dim, sum((1 - 2 * ({digit(5, 1)} % 2)) * (1 + ln(tf))) AS x FROM {name}_tf GROUP BY ALL),
{name} AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_sums)"""


SECOND_SQL = f"""{encoded_sql('docs_v', 'SELECT doc_id AS id, text FROM documents')}, {encoded_sql('items_v', 'SELECT item_id AS id, text FROM benchmark')},
near AS (SELECT q.id AS query_id, d.id, sum(q.x * d.x) AS score FROM items_v q JOIN docs_v d USING (dim) GROUP BY ALL),
second AS (SELECT query_id, id, rank FROM (SELECT i.item_id AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY i.item_id ORDER BY round(coalesce(score, 0), 9) DESC, d.doc_id) AS rank FROM benchmark i CROSS JOIN documents d LEFT JOIN near ON near.query_id = i.item_id AND near.id = d.doc_id) WHERE rank <= 50)"""
HYBRID_SQL = f"""
{bm25f_sql('SELECT item_id AS query_id, text FROM benchmark', k=50)},
{SECOND_SQL},
fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM ranked UNION ALL SELECT query_id, id, rank FROM second) GROUP BY ALL)"""


def second_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector candidates: the fifty documents nearest to each item, of all documents, by the hashing encoder."""
    encoder = encode.HashingEncoder()
    vectors = lambda df, id, name: df.select(F.col(id).alias(name), encoder.encode(T.tokenize(F.col("text"))).alias("v"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = vector.exact_knn(vectors(docs, "doc_id", "id"), vectors(table(spark, sf_dir, "benchmark"), "item_id", "query_id"), 50, exclude_self=False)
    return found.select("query_id", "id", "rank")


@query(f"WITH {SECOND_SQL} SELECT query_id, id, rank FROM second")
def encoded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_list(spark, sf_dir).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYBRID_SQL}, t AS (SELECT query_id, sum(score) AS total FROM fused GROUP BY query_id), s AS (SELECT query_id, id, score / total AS score FROM fused JOIN t USING (query_id)) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10")
def hybrid_without_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector candidates fused and combined, without graph scores."""
    docs = corpus(spark, sf_dir)
    found = lexical.search(docs, table(spark, sf_dir, "benchmark"), "doc_id", FIELDS, "item_id", "text", 50)
    lists = found.select("query_id", F.lit("lexical").alias("list"), "id", "rank", F.lit(1.0).alias("weight")).unionByName(second_list(spark, sf_dir).select("query_id", F.lit("vector").alias("list"), "id", "rank", F.lit(1.0).alias("weight")))
    fused = fusion.reciprocal_rank_fusion(lists, by=["query_id"])
    none = fused.filter("false")
    best = fusion.top(fusion.combine(docs.select(F.col("doc_id").alias("id")), fused, none, 0.0), 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of one source call each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("target"), F.col("source").alias("s"))
    return docs.join(after, "doc_id").filter("source = s").select(F.col("doc_id").alias("source"), "target", F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"))


def _full_sql(rounds: int) -> str:
    out = f"""{HYBRID_SQL},
links AS (SELECT d.doc_id AS a, e.doc_id AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 AND e.source = d.source),
graph AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM links UNION ALL SELECT b, a, 0.5 FROM links) GROUP BY ALL),
steps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM graph),
r AS (SELECT query_id, id, score / sum(score) OVER (PARTITION BY query_id) AS r FROM fused), p0 AS (SELECT query_id, id, r AS score FROM r)"""
    for i in range(rounds):
        out += f""", d{i} AS (SELECT query_id, sum(score) AS d FROM p{i} WHERE id NOT IN (SELECT src FROM steps) GROUP BY query_id),
p{i + 1} AS (SELECT query_id, id, sum(score) AS score FROM (SELECT r.query_id, r.id, (0.15 + 0.85 * coalesce(d, 0)) * r AS score FROM r LEFT JOIN d{i} USING (query_id) UNION ALL SELECT query_id, dst, 0.85 * score * p FROM p{i} JOIN steps ON src = id) GROUP BY query_id, id)"""
    return out + f""", scored AS (SELECT query_id, id, coalesce(r.r, 0) + coalesce(g.score, 0) AS score, coalesce(g.score, 0) AS graph_score FROM p{rounds} g FULL JOIN r USING (query_id, id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= 10)
SELECT b.query_id, b.id, round(b.score, 6) AS score, b.rank, l.id IS NOT NULL AS lexical, v.id IS NOT NULL AS vector, round(graph_score, 6) AS graph_score,
  concat_ws(', ', CASE WHEN l.id IS NOT NULL THEN 'identifier match' END, CASE WHEN v.id IS NOT NULL THEN 'semantic match' END, CASE WHEN graph_score > 0 THEN 'code graph' END) AS reasons
FROM best b LEFT JOIN ranked l ON l.query_id = b.query_id AND l.id = b.id LEFT JOIN second v ON v.query_id = b.query_id AND v.id = b.id"""


@query(f"WITH {_full_sql(4)}")
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates, their graph scores and the reasons, ten best for each of the items."""
    docs = corpus(spark, sf_dir)
    n = docs.select(F.col("doc_id").alias("id"))
    lex = lexical.search(docs, table(spark, sf_dir, "benchmark"), "doc_id", FIELDS, "item_id", "text", 50).persist()
    vec = second_list(spark, sf_dir)
    lists = lex.select("query_id", F.lit("lexical").alias("list"), "id", "rank", F.lit(1.0).alias("weight")).unionByName(vec.select("query_id", F.lit("vector").alias("list"), "id", "rank", F.lit(1.0).alias("weight")))
    fused = fusion.reciprocal_rank_fusion(lists, by=["query_id"])
    g = graph.adjacency(n, graph.with_reverse(document_edges(spark, sf_dir)))
    spread = graph.personalized_pagerank(n, g, fused, exact_rounds=4)
    best = fusion.top(fusion.combine(n, fused, spread), 10)
    return fusion.explain(best, lex, vec, spread).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "lexical", "vector", F.round("graph_score", 6).alias("graph_score"), "reasons")


MAP_SQL = f"""{EDGES_SQL}, named AS (SELECT 'r' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer),
asked AS (SELECT * FROM (VALUES (1, 'ASIA and NATION_3'), (2, 'Customer of EUROPE'), (3, 'zzz')) v(query_id, text)),
terms AS (SELECT DISTINCT id, unnest({sql_code_tokens('name')}) AS term FROM named), words AS (SELECT DISTINCT query_id, unnest({sql_code_tokens('text')}) AS term FROM asked),
shared AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM terms JOIN words USING (term) GROUP BY ALL),
r AS (SELECT query_id, id, score / sum(score) OVER (PARTITION BY query_id) AS r FROM shared UNION ALL SELECT query_id, id, 1.0 / count(*) OVER (PARTITION BY query_id) FROM asked, named WHERE query_id NOT IN (SELECT query_id FROM shared)),
graph AS (SELECT source AS src, target AS dst, sum(CASE kind WHEN 'calls' THEN 1.0 WHEN 'imports' THEN 0.5 WHEN 'contains' THEN 0.3 ELSE 0.1 END * confidence) AS w FROM edges WHERE source IN (SELECT id FROM named) AND target IN (SELECT id FROM named) GROUP BY ALL),
steps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM graph), p0 AS (SELECT query_id, id, r AS score FROM r)"""


def _map_rounds(n: int) -> str:
    out = MAP_SQL
    for i in range(n):
        out += f""", d{i} AS (SELECT query_id, sum(score) AS d FROM p{i} WHERE id NOT IN (SELECT src FROM steps) GROUP BY query_id),
p{i + 1} AS (SELECT query_id, id, sum(score) AS score FROM (SELECT r.query_id, r.id, (0.15 + 0.85 * coalesce(d, 0)) * r AS score FROM r LEFT JOIN d{i} USING (query_id) UNION ALL SELECT query_id, dst, 0.85 * score * p FROM p{i} JOIN steps ON src = id) GROUP BY query_id, id)"""
    return out


@query(f"WITH {_map_rounds(4)} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM p4 QUALIFY rank <= 50")
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline by names: regions, nations and customers as symbols; one query shares no token with any."""
    one = lambda t, p, k, n: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(n).alias("qualname"))
    named = one("region", "r", "r_regionkey", "r_name").unionByName(one("nation", "n", "n_nationkey", "n_name")).unionByName(one("customer", "c", "c_custkey", "c_name"))
    asked = spark.sql("SELECT * FROM VALUES (1, 'ASIA and NATION_3'), (2, 'Customer of EUROPE'), (3, 'zzz') AS t(query_id, text)")
    return _found(graph.repo_map(named, edges(spark, sf_dir), asked, exact_rounds=4))


@query("WITH f AS (SELECT o_custkey AS symbol_id, o_orderkey AS fact_id, CASE o_orderkey % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' ELSE 'orphaned' END AS freshness, o_orderstatus AS text FROM orders) SELECT symbol_id, c_nationkey::VARCHAR AS path, (greatest(1, c_custkey % 90) - 1)::BIGINT AS line, fact_id, freshness, text, n FROM (SELECT *, count(*) OVER (PARTITION BY symbol_id) AS n FROM f QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY CASE freshness WHEN 'fresh' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END, fact_id) = 1) JOIN customer ON c_custkey = symbol_id")
def lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as symbols, their orders as facts."""
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol_id"), k.alias("fact_id"), F.when(k % 3 == 0, "fresh").when(k % 3 == 1, "stale").otherwise("orphaned").alias("freshness"), F.col("o_orderstatus").alias("text"))
    symbols = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("path"), (F.col("c_custkey") % 90).alias("start_line"))
    return graph.lenses(facts, symbols)


@query("WITH s AS (SELECT p_brand AS path, p_partkey AS id, (p_partkey * 7) % 400 AS line FROM part WHERE p_size <> 50), q AS (SELECT s_suppkey AS point_id, 'Brand#' || (11 + s_suppkey % 5) AS path, (s_suppkey * 13) % 420 AS at FROM supplier) SELECT point_id, min(id) AS id FROM (SELECT point_id, id, rank() OVER (PARTITION BY point_id ORDER BY line DESC) AS r FROM q JOIN s ON s.path = q.path AND s.line <= q.at) WHERE r = 1 GROUP BY 1")
def symbol_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that begins last at or above each point; those of size 50 are modules."""
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") == 50, "module").otherwise("function").alias("kind"), ((F.col("p_partkey") * 7) % 400).alias("start_line"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("path"), ((F.col("s_suppkey") * 13) % 420).alias("line"))
    return graph.symbol_at(points, symbols)


@query(f"WITH {EDGES_SQL} SELECT 'version' AS what, 1::BIGINT AS n UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'symbols', count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published snapshot of symbols and edges, and what its status says."""
    e = edges(spark, sf_dir)
    store = files.Snapshots(spark, f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    store.publish({"symbols": nodes(e), "edges": e}, 0)
    return spark.createDataFrame(list(store.status().items()), "what string, n long")


@query(f"WITH {EDGES_SQL}, t AS (SELECT DISTINCT source, target FROM edges WHERE source IN ('n3', 'n7') OR target IN ('n3', 'n7')) SELECT source AS id FROM t UNION SELECT target FROM t")
def neighbour_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.ends(graph.neighbourhood(spark.sql(SEED_NODES), e), nodes(e))


@query(
    f"""WITH {RANKINGS_SQL}, total AS (SELECT query_id, sum(score) AS t FROM fused GROUP BY 1), w AS (SELECT unnest([0.0, 0.02, 0.5])::DOUBLE AS weight),
g AS (SELECT p_brand AS query_id, p_partkey AS id, p_size / 50.0 AS graph FROM part), s AS (SELECT query_id, id, coalesce(score / t, 0) AS share, coalesce(graph, 0) AS graph FROM (SELECT f.*, t FROM fused f JOIN total USING (query_id)) FULL JOIN g USING (query_id, id)),
best AS (SELECT weight, query_id, id FROM s, w QUALIFY row_number() OVER (PARTITION BY weight, query_id ORDER BY round(share + weight * graph, 9) DESC, id) <= 10),
gold AS (SELECT p_brand AS query_id, p_partkey AS id FROM part WHERE p_partkey % 9 = 0), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT weight, query_id, count(*) AS h FROM best JOIN gold USING (query_id, id) GROUP BY ALL)
SELECT weight, round(avg(coalesce(h, 0) / n), 6) AS recall FROM n CROSS JOIN w LEFT JOIN h USING (weight, query_id) GROUP BY 1"""
)
def graph_weight_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as queries, the size of a part as its graph score."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"))
    fused = fusion.reciprocal_rank_fusion(rankings(spark, sf_dir), by=["query_id"])
    found = fusion.tune_graph_weight(fused, part, part.filter("id % 9 = 0").select("query_id", "id"), [0.0, 0.02, 0.5])
    return found.withColumn("recall", F.round("recall", 6))


@query(r"SELECT page_id, (length(head) - length(replace(head, chr(10), '')))::INT AS row, octet_length(encode(split_part(head, chr(10), -1)))::INT AS column FROM (SELECT page_id, substr(html, 1, strpos(html, '<h1>') - 1) AS head FROM pages WHERE contains(html, '<h1>'))")
def byte_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and byte column of each page's heading, from its byte offset."""
    pages = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<h1>")))
    offset = F.octet_length(F.substring_index("html", "<h1>", 1))
    return pages.select("page_id", T.point_of_byte(F.col("html").cast("binary"), offset).alias("p")).select("page_id", "p.row", "p.column")
