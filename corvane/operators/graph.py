"""Graph ranking over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.functions.text import code_tokens
from corvane.session import cut

EDGE_WEIGHTS = {"calls": 1.0, "imports": 0.5, "contains": 0.3, "defines": 0.3, "inherits": 0.7, "tests": 1.0, "config": 0.6, "may_call": 0.3}


def edge_weight(kind: Column, confidence: Column) -> Column:
    """Weight of the kind (0.1 for others) times the confidence, which must be within 0 and 1."""
    base = F.lit(0.1)
    for name, weight in EDGE_WEIGHTS.items():
        base = F.when(kind == name, F.lit(weight)).otherwise(base)
    bad = confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    return F.when(bad, F.raise_error(F.lit("confidence outside [0,1]"))).otherwise(base * confidence)


def with_reverse(edges: DataFrame, factor: float = 0.5) -> DataFrame:
    """The edges, and each reversed at part of its confidence."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", (F.col("confidence") * factor).alias("confidence"))
    return edges.select("source", "target", "kind", "confidence").unionByName(back)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): parallels summed, edges without both ends in nodes dropped.

    Both sides are written first: the optimizer would push the joins into every branch of a union that they are made of, and a task would hold a sort for each.
    """
    known, all_ = cut(nodes.select("id").distinct()), cut(edges.select("source", "target", "kind", "confidence"))
    end = lambda name: known.select(F.col("id").alias(name)).hint("merge")
    kept = all_.join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi")
    weighed = kept.select(F.col("source").alias("src"), F.col("target").alias("dst"), edge_weight(F.col("kind"), F.col("confidence")).alias("w"))
    return weighed.filter("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transitions(graph: DataFrame) -> DataFrame:
    """(src, dst, p): weights as shares of their source. The totals are joined, so no source's edges gather in one window."""
    some = cut(graph.filter("w > 0").select("src", "dst", "w"))
    total = some.groupBy("src").agg(F.sum("w").alias("total"))
    return some.join(total.hint("merge"), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def restart(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, id, r): seeds (query_id, id, score) as shares; uniform for a query whose seeds sum to 0."""
    inside = seeds.join(nodes.select("id").hint("merge"), "id", "left_semi")
    total = seeds.select("query_id").distinct().join(inside.groupBy("query_id").agg(F.sum("score").alias("total")), "query_id", "left").fillna({"total": 0.0})
    shares = inside.join(total.filter("total > 0"), "query_id").select("query_id", "id", (F.col("score") / F.col("total")).alias("r")).filter("r > 0")
    count = nodes.agg(F.count(F.lit(1)).alias("n"))
    # queries go to the nodes, a row each, never the nodes to the queries
    uniform = nodes.select("id").crossJoin(F.broadcast(total.filter("total = 0").select("query_id").crossJoin(F.broadcast(count)))).select("query_id", "id", (1 / F.col("n")).alias("r"))
    return shares.unionByName(uniform)


def _by_source(steps: DataFrame) -> DataFrame:
    """Steps (src, dst, p) kept sorted in parts by their source, so that rounds only bring scores to them."""
    n = (steps := cut(steps)).count()
    return steps.repartition(max(steps.sparkSession.sparkContext.defaultParallelism, n // 200_000 + 1), "src").sortWithinPartitions("src").persist()


def personalized_pagerank(nodes: DataFrame, graph: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, most_rounds: int = 200, exact_rounds: int | None = None, measure_every: int = 5) -> DataFrame:
    """(query_id, id, score) of all seeds' queries at once: one join and one aggregate a round, whatever the number of queries.

    Mass of nodes without outgoing edges goes to the restart distribution. Ends when no query's scores
    move by `tolerance` in sum; exact_rounds fixes the number instead. Scores are sparse: nodes at 0 have no row.
    Scores and steps meet by a sorted join, so neither comes to the driver, however well it compresses.
    """
    nodes = cut(nodes.select("id"))
    steps = _by_source(transitions(graph))
    r = cut(restart(nodes, seeds))
    scores = r.select("query_id", "id", F.col("r").alias("score"))
    few = r.select("query_id").distinct().count() <= 100_000
    rounds = exact_rounds if exact_rounds is not None else most_rounds
    for i in range(rounds):
        # one left join serves both: rows without a step carry the mass that hangs
        moved = scores.hint("merge").join(steps, scores.id == steps.src, "left").select("query_id", "dst", "score", "p").persist()
        hanging = moved.filter("dst is null").groupBy("query_id").agg(F.sum("score").alias("dangling"))
        base = r.join(F.broadcast(hanging) if few else hanging, "query_id", "left").select("query_id", "id", ((1 - damping + damping * F.coalesce("dangling", F.lit(0.0))) * F.col("r")).alias("score"))
        spread = moved.filter("dst is not null").select("query_id", F.col("dst").alias("id"), (damping * F.col("score") * F.col("p")).alias("score"))
        new = cut(base.unionByName(spread).groupBy("query_id", "id").agg(F.sum("score").alias("score")))
        moved.unpersist()
        last = i + 1 == rounds
        if exact_rounds is None and (i % measure_every == measure_every - 1 or last):
            old = scores.withColumnRenamed("score", "old")
            delta = new.join(old.hint("merge"), ["query_id", "id"], "full_outer").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            scores = new
            if delta is None or delta < tolerance:
                break
        scores = new
    steps.unpersist()
    return scores


def push_pagerank(graph: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 200) -> tuple[DataFrame, float, bool]:
    """(scores (id, score), residual, converged) for one seed set (id, score).

    Each round settles the residual of every node at once; what is left unsettled bounds the L1 error, as all
    transitions are nonnegative. Mass of nodes without edges returns to the seeds.
    """
    total = seeds.agg(F.sum("score")).first()[0] or 0.0
    if total <= 0:
        return seeds.select("id", F.lit(0.0).alias("score")).limit(0), 0.0, True
    steps = _by_source(transitions(graph))
    start = cut(seeds.filter("score > 0").select("id", (F.col("score") / total).alias("t")))
    state = start.select("id", F.lit(0.0).alias("settled"), F.col("t").alias("residual"))
    left = 1.0
    for _ in range(most_rounds):
        if left <= tolerance:
            break
        # one left join serves both: rows without a step carry the mass that is stuck
        front = state.filter("residual > 0")
        moved = front.hint("merge").join(steps, front.id == steps.src, "left").select("dst", "residual", "p").persist()
        spread = moved.filter("dst is not null").select(F.col("dst").alias("id"), F.lit(0.0).alias("settled"), (damping * F.col("residual") * F.col("p")).alias("residual"))
        stuck = moved.filter("dst is null").agg(F.coalesce(F.sum("residual"), F.lit(0.0)).alias("mass"))
        back = start.crossJoin(F.broadcast(stuck)).select("id", F.lit(0.0).alias("settled"), (damping * F.col("mass") * F.col("t")).alias("residual"))
        kept = state.select("id", (F.col("settled") + (1 - damping) * F.col("residual")).alias("settled"), F.lit(0.0).alias("residual"))
        # every round is cut: the state is read three times by the next one
        state = cut(kept.unionByName(spread).unionByName(back).groupBy("id").agg(F.sum("settled").alias("settled"), F.sum("residual").alias("residual")))
        moved.unpersist()
        left = state.agg(F.sum("residual")).first()[0] or 0.0
    steps.unpersist()
    return state.filter("settled > 0").select("id", F.col("settled").alias("score")), float(left), left <= tolerance


def expand_callers(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The seeds and whatever calls them."""
    callers = edges.filter("kind = 'calls'").join(seeds.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    return seeds.select("id").union(callers).distinct()


def expand_associations(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The seeds and both ends of test and config edges that touch them."""
    kinds = edges.filter("kind in ('tests', 'config')")
    ids = seeds.select("id")
    touched = kinds.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target").union(kinds.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"))
    return ids.union(touched.select(F.explode(F.array("source", "target")))).distinct()


def neighbours(ids: DataFrame, edges: DataFrame, incoming: bool, kinds: tuple[str, ...] = ("calls", "may_call")) -> DataFrame:
    """(source, target, kind, confidence) of call edges into or out of the ids."""
    key = "target" if incoming else "source"
    return edges.filter(F.col("kind").isin(*kinds)).join(ids.select(F.col("id").alias(key)), key, "left_semi").select("source", "target", "kind", "confidence")


def neighbourhood(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges that touch one of the ids."""
    keys = ids.select("id")
    return edges.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target", "kind", "confidence").union(edges.join(keys.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind", "confidence")).distinct()


def ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols at either end of some edges."""
    return symbols.join(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_semi")


def checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored graph, if it holds: ids once, ends among them, confidence within 0 and 1."""
    if not nodes.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        raise ValueError("an id is there twice, or null")
    if not edges.filter("not coalesce(confidence between 0 and 1, false) or isnan(confidence)").isEmpty():
        raise ValueError("confidence outside 0 and 1")
    if not edges.select(F.explode(F.array("source", "target")).alias("id")).join(nodes.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("an edge has an end that is no node")
    return nodes, edges


def repo_map(symbols: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 50, exact_rounds: int | None = None, language: str = "python") -> DataFrame:
    """(query_id, id, score, rank) of the baseline that knows names only: symbols (id, qualname) are seeded by the tokens they share with a query
    (query_id, text), and the seeds spread over the edges between symbols. A query that shares none begins everywhere."""
    named = symbols.select("id", F.explode(F.array_distinct(code_tokens(F.col("qualname"), language))).alias("term"))
    asked = queries.select("query_id", F.explode(F.array_distinct(code_tokens(F.col("text"), language))).alias("term"))
    shared = named.join(asked, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    # a query without seeds is one row of score 0 of any symbol, which stands for the uniform start
    least = symbols.agg(F.min("id").alias("id"))
    none = queries.select("query_id").distinct().join(shared.select("query_id").distinct(), "query_id", "left_anti").crossJoin(F.broadcast(least)).withColumn("score", F.lit(0.0))
    nodes = symbols.select("id").distinct()
    spread = personalized_pagerank(nodes, adjacency(nodes, edges), shared.unionByName(none), exact_rounds=exact_rounds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return spread.withColumn("rank", place).filter(F.col("rank") <= k)


def lenses(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, path, line, fact_id, freshness, text, n) for each symbol (id, path, start_line) with anchored facts (fact_id, symbol_id, freshness, text):
    its worst fact (orphaned, then stale, then fresh, then by id), and how many there are."""
    worst = F.when(F.col("freshness") == "fresh", 2).when(F.col("freshness") == "stale", 1).otherwise(0)
    best = facts.groupBy("symbol_id").agg(F.min_by(F.struct("fact_id", "freshness", "text"), F.struct(worst.alias("w"), F.col("fact_id").alias("f"))).alias("f"), F.count(F.lit(1)).alias("n"))
    return best.join(symbols.select(F.col("id").alias("symbol_id"), "path", (F.greatest(F.lit(1), F.col("start_line")) - 1).alias("line")), "symbol_id").select("symbol_id", "path", "line", "f.fact_id", "f.freshness", "f.text", "n")


def symbol_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(point_id, id): the symbol (id, path, kind, start_line) that begins last at or above each point (point_id, path, line); modules don't count.

    An as-of join by one ordered pass: points and beginnings of a path are sorted together and the last beginning is carried on.
    """
    starts = symbols.filter("kind <> 'module'").groupBy("path", F.col("start_line").alias("line")).agg(F.min("id").alias("id")).select("path", "line", F.lit(0).alias("_kind"), "id", F.lit(None).cast(dict(points.dtypes)["point_id"]).alias("point_id"))
    asked = points.select("path", F.col("line").cast(dict(starts.dtypes)["line"]).alias("line"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(symbols.dtypes)["id"]).alias("id"), "point_id")
    along = Window.partitionBy("path").orderBy("line", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("id", F.last("id", ignorenulls=True).over(along))
    return found.filter("_kind = 1 and id is not null").select("point_id", "id")
