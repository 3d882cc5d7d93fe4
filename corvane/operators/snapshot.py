"""Content hashes of trees, snapshot differences, moves and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

DOMAIN = "6469726563746f727900"  # "directory\0"


def content_hash(content: Column) -> Column:
    """SHA-256 of the exact bytes."""
    return F.sha2(content.cast("binary"), 256)


def parent_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def directories(children: DataFrame) -> DataFrame:
    """(path, digest) of the directories that hold the children (path, digest, kind)."""
    name = F.encode(F.element_at(F.split("path", "/"), -1), "utf-8")
    child = F.concat(F.col("kind"), F.lpad(F.hex(F.octet_length(name)), 16, "0"), F.hex(name), F.col("digest"))
    rows = children.select(parent_of(F.col("path")).alias("path"), F.struct(F.hex(name).alias("key"), child.alias("child")).alias("c"))
    joined = F.concat(F.lit(DOMAIN), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["child"]), ""))
    return rows.groupBy("path").agg(F.sha2(F.unhex(joined), 256).alias("digest"))


def tree_hashes(leaves: DataFrame, most_depth: int = 64) -> DataFrame:
    """(path, digest, depth) of every directory of the leaves (path, digest); '' is the root.

    A directory's digest covers its children in byte order, each framed by the length of its name. One aggregation a
    level, from the deepest up; directories of one level are hashed side by side.
    """
    depth = leaves.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    if depth > most_depth:
        raise ValueError(f"paths deeper than {most_depth}")
    now = leaves.select("path", "digest", F.lit("66").alias("kind"), F.size(F.split("path", "/")).alias("depth"))  # "f"
    done = None
    for level in range(depth, 0, -1):
        made = directories(now.filter(F.col("depth") == level)).withColumn("kind", F.lit("64")).withColumn("depth", F.lit(level - 1))  # "d"
        done = made if done is None else done.unionByName(made)
        now = now.filter(F.col("depth") < level).unionByName(made)
    if done is None:
        return leaves.select("path", "digest", F.lit(0).alias("depth")).limit(0)
    return done.select("path", "digest", "depth")


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, before, after) where the digests of (path, digest) differ or one is missing."""
    joined = before.select("path", F.col("digest").alias("before")).join(after.select("path", F.col("digest").alias("after")), "path", "full_outer")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def _unique(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(key)
    return df.join(once.hint("merge"), key, "left_semi")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path, old_path): created, modified and deleted paths; a digest that is once among the deleted and once among the created is a move."""
    diff = changed_paths(before, after)
    gone = diff.filter("after is null").select("path", F.col("before").alias("digest"))
    new = diff.filter("before is null").select("path", F.col("after").alias("digest"))
    moves = _unique(gone, "digest").withColumnRenamed("path", "old_path").join(_unique(new, "digest"), "digest").select("path", "old_path")
    kind = F.when(F.col("after").isNull(), "deleted").when(F.col("before").isNull(), "created").otherwise("modified")
    plain = diff.select(kind.alias("kind"), "path", F.lit(None).cast("string").alias("old_path"))
    rest = plain.join(moves.select("path", F.lit("created").alias("kind")), ["path", "kind"], "left_anti").join(moves.select(F.col("old_path").alias("path"), F.lit("deleted").alias("kind")), ["path", "kind"], "left_anti")
    return rest.select("kind", "path", "old_path").unionByName(moves.select(F.lit("moved").alias("kind"), "path", "old_path"))


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged by equality of whole rows."""
    whole = lambda df, name: df.select(key, F.struct(*(c for c in sorted(df.columns) if c != key)).alias(name))
    joined = whole(before, "b").join(whole(after, "a"), key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_id, new_id): a content hash once among removed and once among added ids (id, content_hash)."""
    gone = before.join(after.select("id").hint("merge"), "id", "left_anti").select(F.col("id").alias("old_id"), "content_hash")
    new = after.join(before.select("id").hint("merge"), "id", "left_anti").select(F.col("id").alias("new_id"), "content_hash")
    return _unique(gone, "content_hash").join(_unique(new, "content_hash").hint("merge"), "content_hash").select("old_id", "new_id")


def verified_renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(new_id, old_id) that keep identity: first by path, qualified name and kind, then by a fingerprint unique on both sides.

    before and after (id, path, qualname, kind, fingerprint).
    """
    gone = before.join(after.select("id"), "id", "left_anti")
    new = after.join(before.select("id"), "id", "left_anti")
    place = ["path", "qualname", "kind"]
    first = new.select(F.col("id").alias("new_id"), *place).join(gone.select(F.col("id").alias("old_id"), *place), place).select("new_id", "old_id")
    left_new = new.join(first.select(F.col("new_id").alias("id")), "id", "left_anti").select(F.col("id").alias("new_id"), "fingerprint")
    left_gone = gone.join(first.select(F.col("old_id").alias("id")), "id", "left_anti").select(F.col("id").alias("old_id"), "fingerprint")
    second = _unique(left_new, "fingerprint").join(_unique(left_gone, "fingerprint"), "fingerprint").select("new_id", "old_id")
    return first.unionByName(second)


def prune_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that touch no removed id."""
    ids = removed.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def apply_rows(table: DataFrame, replacements: DataFrame, paths: DataFrame) -> DataFrame:
    """The table with all rows of the paths replaced."""
    gone = paths.select("path").union(replacements.select("path")).distinct()
    return table.join(gone, "path", "left_anti").select(*table.columns).unionByName(replacements)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row for each source, target and kind, with the greatest confidence."""
    return edges.groupBy("source", "target", "kind").agg(F.max("confidence").alias("confidence"))


def external_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows for edge targets that no symbol has."""
    missing = edges.select(F.col("target").alias("id")).distinct().join(symbols.select("id"), "id", "left_anti")
    return missing.select("id", F.lit("<external>").alias("path"), F.element_at(F.split("id", ":"), -1).alias("name"), F.col("id").alias("qualname"), F.lit("variable").alias("kind"), F.sha2("id", 256).alias("content_hash"))


def ancestors_of(paths: DataFrame) -> DataFrame:
    """(path): every directory above the paths, which an incremental refresh must hash again."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()


def refresh_tree(tree: DataFrame, leaves: DataFrame, changed: DataFrame) -> DataFrame:
    """The tree (path, digest, depth) of `leaves` from an earlier one: only directories above changed paths (path) are hashed again.

    Their children are read from the leaves that lie in such a directory and from digests that stay; a directory without children is gone.
    """
    stale = cut(ancestors_of(changed))
    kept = tree.join(stale, "path", "left_anti")
    of_stale = lambda df: df.withColumn("_dir", parent_of(F.col("path"))).join(stale.select(F.col("path").alias("_dir")), "_dir", "left_semi")
    inside = of_stale(leaves).select("path", "digest", F.lit("66").alias("kind"))
    beside = of_stale(kept.filter("path <> ''")).select("path", "digest", F.lit("64").alias("kind"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    children, made = cut(inside.unionByName(beside)), kept.select("path", "digest")
    for d in range(stale.agg(F.max(depth)).first()[0] or 0, -1, -1):
        level = cut(directories(children.filter(F.size(F.split("path", "/")) == d + 1)))
        made = made.unionByName(level)
        children = children.unionByName(level.filter("path <> ''").withColumn("kind", F.lit("64")))
    return made.select("path", "digest", depth.alias("depth"))


def checked_tree(tree: DataFrame) -> DataFrame:
    """A stored tree (path, digest, depth), if it holds: one root, paths once, digests of 64 digits, every directory below another."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    bad = ~F.rlike("digest", F.lit("^[0-9a-f]{64}$")) | (F.col("depth") != depth)
    if not tree.filter(F.coalesce(bad, F.lit(True))).isEmpty() or not tree.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("a directory isn't valid")
    if not tree.isEmpty() and not tree.filter("path <> ''").select(parent_of(F.col("path")).alias("path")).union(tree.sparkSession.sql("SELECT ''")).distinct().join(tree, "path", "left_anti").isEmpty():
        raise ValueError("a directory has none above it")
    return tree
