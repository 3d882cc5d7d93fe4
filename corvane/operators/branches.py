"""Branches of a fact log: commits in a graph, operations in commits, states along first parents.

A commit (commit_id, seq, parents, recorded_at) holds the operations of one write; a branch is a name for a commit. An operation
(op_id, commit_id, seq, kind, fact_id, payload, recorded_at, reverts) says what its fact is afterwards: a payload, or null for nothing. A
merge holds what differs from its first parent, so the state of a commit is the last operation of each fact along
first parents, and no state is stored twice.
"""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import memory as M
from corvane.session import cut
from corvane.sources.files import Snapshots

FACT = "id string, text string, user string, session string, tool string, source string, subject string, confidence double, anchors array<struct<symbol_id:string,content_hash:string>>, derived_from array<string>, valid_from timestamp, valid_to timestamp, created_at timestamp, recorded_at timestamp, freshness string"
TABLES = {
    "commits": "commit_id string, seq long, parents array<string>, recorded_at timestamp, line string, pos long",
    "lines": "line string, up_line string, up_pos long",
    "operations": "op_id string, commit_id string, seq long, kind string, fact_id string, payload string, recorded_at timestamp, reverts string",
    "branches": "name string, head string, active boolean",
    "tombstones": "fact_id string",
    "derivations": "source_id string, derived_id string",
}


def line_of(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, id): commits along the first parents of each head (root, id), itself included.

    Pointers double every round, so rounds grow as the logarithm of the longest line.
    """
    first = commits.select(F.col("commit_id").alias("id"), F.get("parents", F.lit(0)).alias("up")).filter("up is not null")
    reached = heads.select("root", "id").distinct()
    jumps = cut(first)
    while True:
        more = reached.join(jumps, "id").select("root", F.col("up").alias("id"))
        reached = cut(reached.unionByName(more).distinct())
        jumps = cut(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
        if jumps.isEmpty():
            return reached


def states(commits: DataFrame, operations: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, fact_id, payload, seq): the state of each head (root, id)."""
    ops = operations.select(F.col("commit_id").alias("id"), "fact_id", "payload", "seq").join(line_of(commits, heads), "id")
    last = ops.groupBy("root", "fact_id").agg(F.max_by(F.struct("payload", "seq"), "seq").alias("last"))
    return last.select("root", "fact_id", "last.payload", "last.seq").filter("payload is not null")


def before_on(operations: DataFrame, targets: DataFrame) -> DataFrame:
    """As `before`, for targets that are all among operations of one line."""
    wanted = operations.join(targets.select("op_id").distinct(), "op_id", "left_semi").select("op_id", "fact_id", F.col("seq").alias("_at"))
    met = wanted.join(operations.select("fact_id", "payload", "seq"), "fact_id").filter("seq < _at")
    last = met.groupBy("op_id").agg(F.max_by(F.struct("payload"), "seq").alias("last"))
    return wanted.join(last, "op_id", "left").select("op_id", "fact_id", F.col("last.payload").alias("payload"))


def before(commits: DataFrame, operations: DataFrame, targets: DataFrame) -> DataFrame:
    """(op_id, fact_id, payload): what the fact of each target (op_id) was before it along first parents; null: nothing. This is what a revert puts back."""
    wanted = operations.join(targets.select("op_id").distinct(), "op_id", "left_semi").select("op_id", "commit_id", "fact_id", F.col("seq").alias("_at"))
    line = line_of(commits, wanted.select(F.col("op_id").alias("root"), F.col("commit_id").alias("id")))
    earlier = operations.select(F.col("commit_id").alias("id"), "fact_id", "payload", "seq")
    met = line.withColumnRenamed("root", "op_id").join(wanted.select("op_id", "fact_id", "_at"), "op_id").join(earlier, ["id", "fact_id"]).filter("seq < _at")
    last = met.groupBy("op_id").agg(F.max_by(F.struct("payload"), "seq").alias("last"))
    return wanted.join(last, "op_id", "left").select("op_id", "fact_id", F.col("last.payload").alias("payload"))


def _refuse(rows: DataFrame, reason: str) -> None:
    if not rows.isEmpty():
        raise ValueError(reason)


def _refuse_any(rows: DataFrame, *rules: tuple[Column, str]) -> None:
    """The first rule that any row breaks, found in one pass."""
    found = rows.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}") for i, (bad, _) in enumerate(rules))).first()
    for n, (_, reason) in zip(found, rules):
        if n:
            raise ValueError(reason)


class FactStore:
    """A fact log in a folder: every write makes a commit on the active branch and one new version of the tables, or nothing.

    Commits that follow one another are a line, and each has its place on it; a line says where it left another, so the commits behind a head
    are a few ranges of places, found without following parents.
    Versions are published by `Snapshots`, whose manifest is swapped at once: a write that fails, or comes second, leaves what was there.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.snapshots = spark, Snapshots(spark, folder)
        if not self.snapshots.version:
            empty = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
            self.snapshots.publish(empty | {"branches": spark.createDataFrame([("main", None, True)], TABLES["branches"])}, 0)

    def table(self, name: str) -> DataFrame:
        return self.snapshots.load(name)

    def _publish(self, changed: dict[str, DataFrame]) -> None:
        self.snapshots.publish(changed, self.snapshots.version, keep=True)

    # branches
    def branches(self) -> dict[str, str | None]:
        return {r.name: r.head for r in self.table("branches").collect()}

    @property
    def active(self) -> str:
        return self.table("branches").filter("active").first().name

    @property
    def head(self) -> str | None:
        return self.table("branches").filter("active").first().head

    def _set(self, rows: Iterable[tuple[str, str | None, bool]]) -> None:
        self._publish({"branches": self.spark.createDataFrame(list(rows), TABLES["branches"])})

    def _rows(self) -> list[tuple[str, str | None, bool]]:
        return [(r.name, r.head, r.active) for r in self.table("branches").collect()]

    @staticmethod
    def _name(name: str) -> str:
        if not name or re.search(r"[\s~^:?*\[\\]|\.\.|@\{|^[./]|/$|\.lock$|\.$", name):
            raise ValueError("no name for a branch")
        return name

    def branch(self, name: str, head: str | None = None) -> str | None:
        """A new branch at a commit, or where the active one is."""
        if self._name(name) in self.branches():
            raise ValueError("the branch is there already")
        if head is not None and self.table("commits").filter(F.col("commit_id") == head).isEmpty():
            raise KeyError(head)
        self._set([*self._rows(), (name, head or self.head, False)])
        return head or self.head

    def switch(self, name: str) -> None:
        if name not in self.branches():
            raise KeyError(name)
        self._set((n, h, n == name) for n, h, _ in self._rows())

    def rename(self, old: str, new: str) -> None:
        if old not in self.branches():
            raise KeyError(old)
        if self._name(new) in self.branches():
            raise ValueError("the branch is there already")
        self._set((new if n == old else n, h, a) for n, h, a in self._rows())

    def delete(self, name: str) -> None:
        if name not in self.branches():
            raise KeyError(name)
        if name == self.active:
            raise ValueError("the branch is active")
        self._set(r for r in self._rows() if r[0] != name)

    def follow_git(self, root: str) -> str:
        """Switches to the branch that a checkout is on, made if need be; without one to `detached/` and the commit."""
        git = lambda *args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        found = git("symbolic-ref", "--quiet", "--short", "HEAD")
        name = found.stdout.strip() if found.returncode == 0 else "detached/" + git("rev-parse", "--verify", "HEAD").stdout.strip()
        if name not in self.branches():
            self.branch(name)
        self.switch(name)
        return name

    # states
    def _place(self, head: str) -> tuple[str, int]:
        found = self.table("commits").filter(F.col("commit_id") == head).select("line", "pos").first()
        if found is None:
            raise KeyError(head)
        return found.line, found.pos

    def behind(self, head: str | None) -> DataFrame:
        """(commit_id): a commit and those before it along first parents."""
        ranges, up = [], {r.line: (r.up_line, r.up_pos) for r in self.table("lines").collect()} if head else {}
        at = self._place(head) if head else (None, None)
        while at[0] is not None:
            ranges.append(at)
            at = up[at[0]]
        limits = F.broadcast(self.spark.createDataFrame(ranges, "line string, last long"))  # a row a line
        return self.table("commits").join(limits, "line").filter("pos <= last").select("commit_id")

    def _operations(self, head: str | None) -> DataFrame:
        return self.table("operations").join(self.behind(head), "commit_id", "left_semi")

    def state(self, head: str | None = None) -> DataFrame:
        """(fact_id, payload, seq) at a commit; without one at the head of the active branch."""
        last = self._operations(head or self.head).groupBy("fact_id").agg(F.max_by(F.struct("payload", "seq"), "seq").alias("last"))
        return last.select("fact_id", "last.payload", "last.seq").filter("payload is not null").join(self.table("tombstones"), "fact_id", "left_anti")

    def facts(self, head: str | None = None) -> DataFrame:
        """The facts as columns."""
        return self.state(head).select(F.from_json("payload", FACT).alias("f")).select("f.*")

    def _commit(self, changes: DataFrame, extra: dict[str, DataFrame] | None = None, second: str | None = None) -> str:
        """Writes operations (kind, fact_id, payload, reverts) as a commit after the head, in order of fact_id; times pass those of all commits before."""
        commits, head = self.table("commits"), self.head
        last = commits.agg(F.max("seq"), F.max("recorded_at")).first()
        seq, name = (last[0] or 0) + 1, uuid.uuid4().hex
        now = F.greatest(F.current_timestamp(), F.lit(last[1]) + F.expr("INTERVAL 1 MICROSECOND")) if last[1] else F.current_timestamp()
        stamped = cut(self.spark.range(1).select(now.alias("t"))).first().t
        line, pos = self._place(head) if head else (None, -1)
        lines = {}
        if line is None or not commits.filter((F.col("line") == line) & (F.col("pos") > pos)).isEmpty():
            lines = {"lines": self.table("lines").unionByName(self.spark.createDataFrame([(name, line, pos if line else None)], TABLES["lines"]))}
            line, pos = name, -1
        made = self.spark.createDataFrame([(name, seq, [x for x in (head, second) if x], stamped, line, pos + 1)], TABLES["commits"])
        ops = cut(changes).select("kind", "fact_id", "payload", "reverts")
        if ops.groupBy("fact_id").count().filter("count > 1").count():
            raise ValueError("a fact changes twice in one write")
        op_id = F.sha2(F.concat_ws("\0", F.lit(name), "kind", "fact_id", F.coalesce("payload", F.lit(""))), 256)
        rows = ops.select(op_id.alias("op_id"), F.lit(name).alias("commit_id"), F.lit(seq).cast("long").alias("seq"), "kind", "fact_id", "payload", F.lit(stamped).alias("recorded_at"), "reverts")
        branches = self.spark.createDataFrame([(n, name if a else h, a) for n, h, a in self._rows()], TABLES["branches"])
        self._publish({"commits": commits.unionByName(made), "operations": self.table("operations").unionByName(rows), "branches": branches} | lines | (extra or {}))
        return name

    # writes
    def remember(self, facts: DataFrame) -> str:
        """Adds facts; columns of FACT that `facts` lacks are null (confidence 1). What doesn't hold refuses the whole write."""
        given = set(facts.columns)
        schema = [f.split(" ") for f in FACT.split(", ")]
        default = {"confidence": F.lit(1.0), "id": F.expr("uuid()"), "freshness": F.lit("fresh")}
        rows = facts.select(*((F.col(n) if n in given else default.get(n, F.lit(None))).cast(t).alias(n) for n, t in schema))
        rows = cut(rows.withColumns({"recorded_at": F.current_timestamp(), "created_at": F.current_timestamp(), "valid_from": F.coalesce("valid_from", F.current_timestamp()), "derived_from": F.array_distinct(F.coalesce("derived_from", F.array().cast("array<string>")))}))
        blank = lambda c: F.col(c).isNotNull() & (F.btrim(c) == "")
        anchors = F.transform("anchors", lambda a: a["symbol_id"])
        empty = F.exists("anchors", lambda a: (F.coalesce(a["symbol_id"], F.lit("")) == "") | (F.coalesce(a["content_hash"], F.lit("")) == ""))
        _refuse_any(
            rows,
            (F.col("text").isNull() | blank("text"), "a fact needs a text"),
            (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence is within 0 and 1"),
            (blank("user") | blank("session") | blank("tool") | blank("source") | blank("subject"), "no blank metadata"),
            (F.expr("valid_to is not null and valid_to <= valid_from"), "an interval ends after it begins"),
            (F.coalesce(empty, F.lit(False)) | (F.size(F.array_distinct(anchors)) < F.size(anchors)), "anchors have a symbol each, and its hash"),
        )
        known = cut(self.state().select("fact_id"))
        flag = lambda df, name: df.select("fact_id").distinct().withColumn(name, F.lit(True))
        ids = rows.select(F.col("id").alias("fact_id")).join(flag(self.table("tombstones"), "gone"), "fact_id", "left").join(flag(known, "there"), "fact_id", "left")
        _refuse_any(ids, (F.col("gone"), "what was forgotten isn't remembered again"), (F.col("there"), "the fact is there already"))
        sources = rows.select(F.explode("derived_from").alias("source_id"), F.col("id").alias("derived_id")).distinct()
        derivations = self.table("derivations")
        if not sources.isEmpty():
            _refuse(sources.join(known.withColumnRenamed("fact_id", "source_id"), "source_id", "left_anti"), "facts derive from facts of the branch")
            _refuse(M.would_cycle(derivations.unionByName(sources), sources), "derivations go round in a circle")
        return self._commit(rows.select(F.lit("add").alias("kind"), F.col("id").alias("fact_id"), F.to_json(F.struct(*(n for n, _ in schema))).alias("payload"), F.lit(None).cast("string").alias("reverts")), None if sources.isEmpty() else {"derivations": derivations.unionByName(sources).distinct()})

    def update(self, changes: DataFrame) -> str:
        """New texts or intervals (fact_id, text, valid_from, valid_to; null: as it was)."""
        named = changes.select("fact_id", *(F.col(c).cast(t).alias(f"new_{c}") if c in changes.columns else F.lit(None).cast(t).alias(f"new_{c}") for c, t in (("text", "string"), ("valid_from", "timestamp"), ("valid_to", "timestamp"))))
        rows = cut(named.join(self.state(), "fact_id", "left"))
        _refuse_any(rows, (F.col("payload").isNull(), "no such fact"), (F.btrim("new_text") == "", "a fact needs a text"))
        rows = rows.withColumn("f", F.from_json("payload", FACT))
        new = F.col("f")
        for c in ("text", "valid_from", "valid_to"):
            new = new.withField(c, F.coalesce(f"new_{c}", f"f.{c}"))
        rows = rows.withColumn("f", new.withField("recorded_at", F.current_timestamp()))
        _refuse(rows.filter("f.valid_to is not null and f.valid_to <= f.valid_from"), "an interval ends after it begins")
        return self._commit(rows.select(F.lit("update").alias("kind"), "fact_id", F.to_json("f").alias("payload"), F.lit(None).cast("string").alias("reverts")))

    def invalidate(self, facts: DataFrame) -> str:
        _refuse(facts.join(self.state(), "fact_id", "left_anti"), "no such fact")
        none = F.lit(None).cast("string")
        return self._commit(facts.select(F.lit("invalidate").alias("kind"), "fact_id", none.alias("payload"), none.alias("reverts")).distinct())

    def revert(self, op_ids: list[str]) -> str:
        """Puts back what the facts of some operations of the branch were before them; an operation is reverted once, and what was forgotten never."""
        targets = self.spark.createDataFrame([(i,) for i in op_ids], "op_id string").distinct()
        mine = cut(self._operations(self.head))
        on_line = targets.join(mine, "op_id", "left_anti").isEmpty()
        if not on_line:  # of a branch that was merged, perhaps
            commits = self.table("commits").withColumnRenamed("commit_id", "op_id")
            reach = M.ancestry(commits, self.spark.createDataFrame([("", self.head)] if self.head else [], "root string, id string"))
            mine = cut(self.table("operations").join(reach.select(F.col("id").alias("commit_id")), "commit_id", "left_semi"))
        flag = lambda df, key, name: df.select(F.col(key).alias("op_id")).filter("op_id is not null").distinct().withColumn(name, F.lit(True))
        found = targets.join(mine.select("op_id", "kind", "fact_id"), "op_id", "left").join(flag(mine, "reverts", "done"), "op_id", "left").join(self.table("tombstones").withColumn("gone", F.lit(True)), "fact_id", "left")
        _refuse_any(
            found,
            (F.col("kind").isNull(), "the operation isn't on the branch"),
            (F.col("done"), "the operation is reverted already"),
            (F.col("kind") == "revert", "a revert isn't reverted"),
            (F.col("gone"), "what was forgotten isn't restored"),
        )
        back = before_on(mine, targets) if on_line else before(self.table("commits"), self.table("operations"), targets)
        return self._commit(back.select(F.lit("revert").alias("kind"), "fact_id", "payload", F.col("op_id").alias("reverts")))

    def revert_commit(self, commit_id: str) -> str:
        """All that a commit, a merge for example, changed."""
        return self.revert([r.op_id for r in self.table("operations").filter(F.col("commit_id") == commit_id).select("op_id").collect()])

    def common_base(self, left: str | None, right: str | None) -> str | None:
        if not left or not right:
            return None
        commits = self.table("commits").withColumnRenamed("commit_id", "op_id")
        reach = M.ancestry(commits, self.spark.createDataFrame([("l", left), ("r", right)], "root string, id string"))
        found = [r.op_id for r in M.common_base(reach.filter("root = 'l'"), reach.filter("root = 'r'"), commits).collect()]
        if len(found) > 1:
            raise ValueError("several merge bases")
        return found[0] if found else None

    def preview(self, other: str) -> DataFrame:
        """The three-way merge of another branch into the active one; times of recording don't count."""
        theirs = self.branches()[other]
        bare = lambda df: df.select("fact_id", F.to_json(F.from_json("payload", FACT).dropFields("recorded_at")).alias("payload"))
        base = self.common_base(self.head, theirs)
        empty = self.state().limit(0)
        return M.merge_preview(bare(self.state(base)) if base else bare(empty), bare(self.state()), bare(self.state(theirs)) if theirs else bare(empty), self.table("tombstones"))

    def merge(self, other: str, resolutions: DataFrame | None = None) -> str:
        """A commit with two parents; conflicts need resolutions (fact_id, choice)."""
        result = cut(M.merge(cut(self.preview(other)), resolutions))
        ours = self.state().select("fact_id", F.to_json(F.from_json("payload", FACT).dropFields("recorded_at")).alias("payload"))
        changed = M.diff(ours, result)
        rows = changed.select(F.lit("merge").alias("kind"), "fact_id", F.col("after").alias("payload"), F.lit(None).cast("string").alias("reverts"))
        return self._commit(rows, second=self.branches()[other])

    def forget(self, facts: DataFrame) -> list[str]:
        """Erases facts (id) and all that derives from them, from every branch, table and version; says which."""
        operations = self.table("operations")
        _refuse(facts.join(operations.select(F.col("fact_id").alias("id")).union(self.table("tombstones")), "id", "left_anti"), "no such fact")
        kept, gone = M.forget({"operations": operations}, self.table("derivations"), facts)
        stones = cut(self.table("tombstones").unionByName(gone.select("fact_id")).distinct())
        left = self.table("derivations").join(gone.select(F.col("fact_id").alias("derived_id")), "derived_id", "left_anti").select("source_id", "derived_id")
        self._publish({"operations": kept["operations"], "tombstones": stones, "derivations": left})
        self.snapshots.erase(self.snapshots.version)
        return sorted(r.fact_id for r in gone.collect())
