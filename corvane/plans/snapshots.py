"""Queries for trees, differences and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import snapshot as S
from corvane.plans.adapters import EDGES_SQL, edges, nodes
from corvane.plans.registry import query, table


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host and id are the path."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("/"), F.pmod("page_id", F.lit(3)).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("path"), S.content_hash(F.col("html")).alias("digest"))


LEAVES_SQL = "leaves AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) || '/' || (page_id % 3) || '/' || page_id AS path, sha256(html) AS digest FROM pages)"


def _level(name: str, source: str, kind: str) -> str:
    child = f"'{kind}' || lpad(printf('%X', octet_length(encode(split_part(path, '/', -1)))), 16, '0') || hex(encode(split_part(path, '/', -1))) || digest"
    parent = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
    return f"{name} AS (SELECT p AS path, sha256(unhex('{S.DOMAIN}' || string_agg(c, '' ORDER BY k))) AS digest FROM (SELECT {parent} AS p, hex(encode(split_part(path, '/', -1))) AS k, {child} AS c FROM {source}) GROUP BY p)"


@query(f"WITH {LEAVES_SQL}, {_level('l2', 'leaves', '66')}, {_level('l1', 'l2', '64')}, {_level('l0', 'l1', '64')} SELECT path, digest, 2 AS depth FROM l2 UNION ALL SELECT path, digest, 1 FROM l1 UNION ALL SELECT path, digest, 0 FROM l0")
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree_hashes(leaves(spark, sf_dir))


BEFORE_SQL = "before AS (SELECT o_orderkey::VARCHAR AS path, sha256(o_orderkey::VARCHAR || o_orderstatus) AS digest FROM orders)"
AFTER_SQL = "after AS (SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'moved' || o_orderkey ELSE o_orderkey::VARCHAR END AS path, sha256(o_orderkey::VARCHAR || CASE WHEN o_orderkey % 17 = 0 THEN 'edited' ELSE o_orderstatus END) AS digest FROM orders WHERE o_orderkey % 23 <> 0)"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: some edited, some deleted, some moved to another key."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    before = orders.select(key.cast("string").alias("path"), F.sha2(F.concat(key.cast("string"), "o_orderstatus"), 256).alias("digest"))
    after = orders.filter(key % 23 != 0).select(
        F.when(key % 29 == 0, F.concat(F.lit("moved"), key.cast("string"))).otherwise(key.cast("string")).alias("path"),
        F.sha2(F.concat(key.cast("string"), F.when(key % 17 == 0, "edited").otherwise(F.col("o_orderstatus"))), 256).alias("digest"),
    )
    return before, after


@query(f"WITH {BEFORE_SQL}, {AFTER_SQL} SELECT coalesce(b.path, a.path) AS path, b.digest AS before, a.digest AS after FROM before b FULL JOIN after a ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changed_paths(*versions(spark, sf_dir))


@query(
    f"""WITH {BEFORE_SQL}, {AFTER_SQL},
gone AS (SELECT * FROM before WHERE path NOT IN (SELECT path FROM after)), new AS (SELECT * FROM after WHERE path NOT IN (SELECT path FROM before)),
moves AS (SELECT n.path, g.path AS old_path FROM gone g JOIN new n USING (digest) WHERE digest IN (SELECT digest FROM gone GROUP BY 1 HAVING count(*) = 1) AND digest IN (SELECT digest FROM new GROUP BY 1 HAVING count(*) = 1))
SELECT 'deleted' AS kind, path, NULL::VARCHAR AS old_path FROM gone WHERE path NOT IN (SELECT old_path FROM moves)
UNION ALL SELECT 'created', path, NULL FROM new WHERE path NOT IN (SELECT path FROM moves)
UNION ALL SELECT 'modified', a.path, NULL FROM before b JOIN after a USING (path) WHERE a.digest <> b.digest
UNION ALL SELECT 'moved', path, old_path FROM moves"""
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changes(*versions(spark, sf_dir))


@query(
    """SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.p IS NOT DISTINCT FROM b.p AND a.s IS NOT DISTINCT FROM b.s THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT p_partkey AS k, p_retailprice AS p, p_size AS s FROM part WHERE p_partkey % 5 <> 0) b
FULL JOIN (SELECT p_partkey AS k, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS p, p_size AS s FROM part WHERE p_partkey % 7 <> 0) a ON a.k = b.k"""
)
def symbol_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("p"), F.col("p_size").alias("s"))
    after = part.filter("k % 7 <> 0").withColumn("p", F.col("p") + F.when(F.col("k") % 3 == 0, 1).otherwise(0))
    return S.delta(part.filter("k % 5 <> 0"), after, "k")


@query(
    """WITH b AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), a AS (SELECT doc_id + 1000000 AS id, sha256(text) AS h FROM documents WHERE doc_id % 4 = 0)
SELECT b.id AS old_id, a.id AS new_id FROM b JOIN a USING (h) WHERE h IN (SELECT h FROM b GROUP BY 1 HAVING count(*) = 1) AND h IN (SELECT h FROM a GROUP BY 1 HAVING count(*) = 1)"""
)
def identical_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.content_hash(F.col("text")).alias("content_hash"))
    return S.renames(docs.filter("id % 2 = 0"), docs.filter("id % 4 = 0").withColumn("id", F.col("id") + 1_000_000))


@query(
    """WITH b AS (SELECT p_partkey AS id, p_brand AS path, p_name AS qualname, p_type AS kind, p_size * 1000 + p_partkey % 1000 AS fingerprint FROM part),
a AS (SELECT p_partkey + 1000000000 AS id, p_brand AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '!' END AS qualname, p_type AS kind, p_size * 1000 + p_partkey % 1000 AS fingerprint FROM part),
f AS (SELECT a.id AS new_id, b.id AS old_id FROM a JOIN b USING (path, qualname, kind)),
ra AS (SELECT * FROM a WHERE id NOT IN (SELECT new_id FROM f)), rb AS (SELECT * FROM b WHERE id NOT IN (SELECT old_id FROM f))
SELECT * FROM f UNION ALL SELECT ra.id, rb.id FROM ra JOIN rb USING (fingerprint) WHERE fingerprint IN (SELECT fingerprint FROM ra GROUP BY 1 HAVING count(*) = 1) AND fingerprint IN (SELECT fingerprint FROM rb GROUP BY 1 HAVING count(*) = 1)"""
)
def verified_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("qualname"), F.col("p_type").alias("kind"), (F.col("p_size") * 1000 + F.col("p_partkey") % 1000).alias("fingerprint"))
    a = b.select((F.col("id") + 1_000_000_000).alias("id"), "path", F.when(F.col("id") % 2 == 0, F.col("qualname")).otherwise(F.concat("qualname", F.lit("!"))).alias("qualname"), "kind", "fingerprint")
    return S.verified_renames(b, a)


@query(f"WITH {EDGES_SQL} SELECT * FROM edges WHERE source NOT IN ('n3', 'n4') AND target NOT IN ('n3', 'n4')")
def prune_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prune_edges(edges(spark, sf_dir), spark.sql("SELECT 'n3' AS id UNION ALL SELECT 'n4'"))


@query(
    """SELECT p_brand AS path, p_partkey AS id, p_size AS size FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')
UNION ALL SELECT 'Brand#11', p_partkey, p_size + 100 FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 2 = 0"""
)
def apply_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    new = rows.filter("path = 'Brand#11' AND id % 2 = 0").withColumn("size", F.col("size") + 100)
    return S.apply_rows(rows, new, spark.sql("SELECT 'Brand#12' AS path"))


@query("SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_returnflag AS kind, max(l_discount) AS confidence FROM lineitem GROUP BY ALL")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges collapse to the greatest confidence."""
    lines = table(spark, sf_dir, "lineitem")
    return S.distinct_edges(lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence")))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT target AS id, '<external>' AS path, target AS name, target AS qualname, 'variable' AS kind, sha256(target) AS content_hash FROM edges WHERE target NOT LIKE 'c%'")
def external_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return S.external_symbols(e, nodes(e).filter("id like 'c%'"))


EDITED_SQL = "leaves AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) || '/' || (page_id % 3) || '/' || page_id AS path, sha256(html || CASE WHEN page_id % 10 = 7 THEN 'edited' ELSE '' END) AS digest FROM pages WHERE page_id % 50 <> 3)"


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages later: a tenth are edited, some are gone."""
    pages = table(spark, sf_dir, "pages").filter("page_id % 50 <> 3")
    html = F.concat("html", F.when(F.col("page_id") % 10 == 7, "edited").otherwise(""))
    return pages.select(F.concat(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("/"), F.pmod("page_id", F.lit(3)).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("path"), S.content_hash(html).alias("digest"))


@query(f"WITH {LEAVES_SQL.replace('leaves', 'before')}, {EDITED_SQL.replace('leaves', 'after')}, p AS (SELECT coalesce(b.path, a.path) AS path FROM before b FULL JOIN after a ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest) SELECT '' AS path UNION SELECT split_part(path, '/', 1) FROM p UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p")
def merkle_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories above what changed between two versions of the pages."""
    return S.ancestors_of(S.changed_paths(leaves(spark, sf_dir), edited(spark, sf_dir)))


@query(f"WITH {EDITED_SQL}, {_level('l2', 'leaves', '66')}, {_level('l1', 'l2', '64')}, {_level('l0', 'l1', '64')} SELECT path, digest, 2 AS depth FROM l2 UNION ALL SELECT path, digest, 1 FROM l1 UNION ALL SELECT path, digest, 0 FROM l0")
def merkle_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the later version from that of the earlier: only directories above changes are hashed again; equal to a fresh tree."""
    before, after = leaves(spark, sf_dir), edited(spark, sf_dir)
    return S.refresh_tree(S.tree_hashes(before), after, S.changed_paths(before, after))
