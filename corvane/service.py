"""The engine over a repository: scan, parse, resolve and index into snapshots, and the questions asked of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import encode, fusion, graph, lexical, memory, packing, resolve, vector
from corvane.operators.branches import FactStore
from corvane.session import cut, small
from corvane.sources import files

FIELDS = ["signature", "docstring", "body"]
CANDIDATES = 50
#: What scores may still move by, in sum over all symbols of a task.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class Indexed:
    version: int
    files: int
    symbols: int
    edges: int
    reparsed: int


class Repository:
    """A repository's folder and, elsewhere or below it, the state: snapshots, postings and vectors of each version, and the facts."""

    def __init__(self, spark: SparkSession, root: str, state: str | None = None, encoder: encode.HashingEncoder | None = None) -> None:
        self.spark, self.root = spark, root
        self.state = state or f"{root.rstrip('/')}/.corvane"
        self.snapshots = files.Snapshots(spark, f"{self.state}/snapshots")
        self.cache = files.RetrievalCache(spark, f"{self.state}/cache")
        self.encoder = encoder or encode.HashingEncoder()

    # the index
    def index(self) -> Indexed:
        """Publishes a version if files changed: only changed files are parsed again; then facts are held against the new symbols."""
        found = cut(files.scan(self.spark, self.root, (*files.EXCLUDED, ".corvane")))
        version = self.snapshots.version
        before = self.snapshots.load("parsed") if version else None
        if before is not None and self._same(found, before):
            return self._indexed(version, 0)
        parsed, again = resolve.parsed_incremental(found, before)
        parsed = cut(parsed)
        symbols = resolve.table(parsed, "symbols")
        edges = cut(resolve.resolve(parsed))
        external = edges.select(F.col("target").alias("id")).distinct().join(symbols.select("id"), "id", "left_anti")
        outside = external.select("id", F.lit("<external>").alias("path"), F.element_at(F.split("id", ":"), -1).alias("name"), F.col("id").alias("qualname"), F.lit("variable").alias("kind"), F.sha2("id", 256).alias("content_hash"))
        everything = symbols.unionByName(outside, allowMissingColumns=True)
        old = self.snapshots.load("symbols") if version else None
        made = self.snapshots.publish({"parsed": parsed, "symbols": everything, "edges": edges}, version)
        if old is not None:
            self.refresh_facts(cut(old.select("id", "content_hash")))
        return self._indexed(made, again)

    @staticmethod
    def _same(found: DataFrame, before: DataFrame) -> bool:
        both = found.select("path", "digest").join(before.select("path", F.col("digest").alias("was")), "path", "full_outer")
        return both.filter(~F.col("digest").eqNullSafe(F.col("was"))).isEmpty()

    def _indexed(self, version: int, again: int) -> Indexed:
        status = self.snapshots.status()
        return Indexed(version, status["parsed"], status["symbols"], status["edges"], again)

    def status(self) -> dict[str, int]:
        return self.snapshots.status()

    def symbols(self) -> DataFrame:
        return self.snapshots.load("symbols")

    def chunks(self) -> DataFrame:
        return resolve.chunks(self.symbols().filter("path <> '<external>'"))

    def edges(self) -> DataFrame:
        return self.snapshots.load("edges")

    # lookups
    def find_symbol(self, name: str) -> DataFrame:
        """Symbols whose name or qualified name holds the text, case aside, or whose id it is; by path and line."""
        asked = T.fold(F.lit(name))
        hit = F.contains(T.fold(F.col("name")), asked) | F.contains(T.fold(F.col("qualname")), asked) | (F.col("id") == name)
        return self.symbols().filter(hit).orderBy("path", "start_line", "id")

    def calls(self, name: str, incoming: bool) -> DataFrame:
        named = self.symbols().filter((F.col("name") == name) | (F.col("qualname") == name) | (F.col("id") == name)).select("id")
        return graph.neighbours(named, self.edges(), incoming)

    def neighbourhood(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(edges that touch the symbols of a name, the symbols at their ends)."""
        named = self.symbols().filter((F.col("name") == name) | (F.col("qualname") == name) | (F.col("id") == name)).select("id")
        touching = cut(graph.neighbourhood(named, self.edges()))
        return touching, graph.ends(touching, self.symbols())

    # ranking
    def _postings(self) -> lexical.PostingsIndex:
        folder = f"{self.state}/postings/v{self.snapshots.version}"
        store = files.Store(self.spark, folder)
        if not store.exists("done"):
            for name in store.names():
                store.delete(name)  # what an attempt before left
            lexical.PostingsIndex.build(self.chunks().select("id", *(F.coalesce(f, F.lit("")).alias(f) for f in FIELDS)), "id", FIELDS, folder)
            store.write("done", "")
        return lexical.PostingsIndex(self.spark, folder, FIELDS)

    def _vectors(self) -> DataFrame:
        text = F.concat_ws("\n", "signature", "docstring", "body")
        make = lambda: {"vectors": self.chunks().select("id", self.encoder.encode(T.tokenize(text)).alias("v"))}
        return self.cache.get({"vectors": self.snapshots.version, "encoder": self.encoder.version}, make)["vectors"]

    def rank(self, tasks: DataFrame, graph_weight: float = 1.0, vectors: bool = True, most: int | None = None) -> DataFrame:
        """(query_id, id, score, rank, lexical, vector, graph_score, reasons) for tasks (query_id, text): fifty candidates by words and fifty by vectors, fused, and spread over the graph."""
        tasks = cut(tasks.select("query_id", "text"))
        nodes = self.symbols().select("id")
        words = cut(self._postings().search(tasks, "query_id", "text", CANDIDATES))
        asked = tasks.select("query_id", self.encoder.encode(T.tokenize(F.col("text"))).alias("v"))
        near = cut(vector.exact_knn(*self._numbered(self._vectors(), asked), CANDIDATES, exclude_self=False)) if vectors else None
        lists = words.select("query_id", F.lit("lexical").alias("list"), "id", "rank", F.lit(1.0).alias("weight"))
        named = self._named(near) if near is not None else words.select("query_id", "id", "rank").limit(0)
        fused = cut(fusion.reciprocal_rank_fusion(lists.unionByName(named.select("query_id", F.lit("vector").alias("list"), "id", "rank", F.lit(1.0).alias("weight"))), by=["query_id"]))
        spread = words.select("query_id", "id", "score").limit(0)
        if graph_weight:
            spread = graph.personalized_pagerank(nodes, graph.adjacency(nodes, graph.with_reverse(self.edges())), fused, tolerance=TOLERANCE)
        best = fusion.combine(nodes, fused, spread, graph_weight)
        found = fusion.explain(fusion.top(best, most or 1 << 30), words, named, spread)
        return found

    def _numbered(self, vectors: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vectors under numbers, as the exact search works on these; the number is a hash of the id."""
        self._names = cut(vectors.select("id", F.xxhash64("id").alias("number")))
        return vectors.select(F.xxhash64("id").alias("id"), "v"), asked.select(F.col("query_id").cast("long").alias("query_id"), "v")

    def _named(self, near: DataFrame) -> DataFrame:
        return near.withColumnRenamed("id", "number").join(small(self._names), "number").select("query_id", "id", "rank")

    def context(self, tasks: DataFrame, budget: int, preamble: str = "", method: str = "knapsack", graph_weight: float = 1.0) -> DataFrame:
        """(query_id, text, cost, budget, items, covered) for tasks (query_id, text); the same task of the same version is ranked once."""
        key = {"version": self.snapshots.version, "tasks": sorted((r.query_id, T.plain_query(r.text)) for r in tasks.collect()), "weight": graph_weight, "encoder": self.encoder.version}
        ranked = self.cache.get(key, lambda: {"ranking": self.rank(tasks, graph_weight)})["ranking"]
        budgets = tasks.select("query_id", F.lit(budget).cast("long").alias("budget"), F.lit(preamble).alias("preamble"))
        known = self.symbols().filter("path <> '<external>'")
        return packing.context(known, ranked.select("query_id", "id", "score", "rank", F.nullif("reasons", F.lit("")).alias("reasons")).join(known.select("id"), "id", "left_semi"), budgets, method)

    # facts
    @property
    def facts(self) -> FactStore:
        return FactStore(self.spark, f"{self.state}/facts")

    def remember(self, text: str, anchors: list[str] = (), **fields) -> str:
        """A fact anchored to symbols by their ids, with the hashes that these have now."""
        store = self.facts
        hashes = {r.id: r.content_hash for r in self.symbols().filter(F.col("id").isin(*anchors)).select("id", "content_hash").collect()} if anchors else {}
        if len(hashes) != len(anchors):
            raise KeyError("no such symbol")
        row = {"text": text, "anchors": [(a, hashes[a]) for a in anchors], **fields}
        schema = ", ".join(f for f in "text string, anchors array<struct<symbol_id:string,content_hash:string>>, id string, user string, session string, tool string, source string, subject string, confidence double, derived_from array<string>, freshness string".split(", ") if f.split(" ")[0] in row)
        return store.remember(self.spark.createDataFrame([tuple(row[f.split(" ")[0]] for f in schema.split(", "))], schema))

    def recall(self, query: str | None = None, include_stale: bool = True) -> DataFrame:
        """Facts of the active branch in the order of recall, those that match if a query is given."""
        facts = self.facts.facts()
        rows = facts.select(F.col("id").alias("fact_id"), F.concat_ws(" ", F.transform("anchors", lambda a: a["symbol_id"])).alias("anchors_text"), "subject", "text", "freshness", "confidence")
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string") if query else None
        return memory.rank_recall(rows, asked, include_stale).orderBy("place")

    def refresh_facts(self, before: DataFrame) -> None:
        """Marks facts whose anchored symbols are gone or differ, following renames; writes an update only for facts that change."""
        store = self.facts
        facts = store.facts()
        if facts.isEmpty():
            return
        anchors = facts.select(F.col("id").alias("fact_id"), F.explode("anchors").alias("a")).select("fact_id", "a.*")
        state, moved = memory.refresh_after(facts.select(F.col("id").alias("fact_id"), "freshness"), anchors, before, self.symbols().select("id", "content_hash"))
        listed = moved.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "content_hash"))).alias("anchors"))
        new = facts.withColumnRenamed("freshness", "was").join(state.withColumnRenamed("fact_id", "id"), "id").withColumnRenamed("anchors", "had").join(listed.withColumnRenamed("fact_id", "id"), "id", "left")
        changed = new.filter((F.col("was") != F.col("freshness")) | (F.array_sort("had") != F.col("anchors")))
        payload = F.to_json(F.struct(*(F.coalesce("anchors", F.col("had")).alias("anchors") if n == "anchors" else F.col(n) for n in facts.columns)))
        rows = cut(changed.select(F.lit("update").alias("kind"), F.col("id").alias("fact_id"), payload.alias("payload"), F.lit(None).cast("string").alias("reverts")))
        if not rows.isEmpty():
            store._commit(rows)


def rows(df: DataFrame, most: int = 1_000) -> list[dict]:
    """For display; how many is the feature."""
    return [json.loads(r) for r in df.limit(most).toJSON().collect()]


Clock = Callable[[], str]
