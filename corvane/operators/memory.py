"""An event-sourced, bitemporal, branching fact log.

Operations are rows (seq, op_id, kind, fact_id, payload, recorded_at, ...); kinds are add, update, revert, invalidate,
forget, and the snapshots merge and restore. A log can hold many streams: `by` names the columns that tell them apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.operators.lexical import search
from corvane.operators.snapshot import renames
from corvane.session import cut, small

SOURCE_PRIORITY = {"code": 3, "test": 2, "user": 1}


def canonical(value: object) -> str:
    """Sorted keys, no blanks, non-ASCII kept, no NaN: the text that identities are hashed from."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def operation_id(kind: Column, fact_id: Column, payload_hash: Column, parents: Column, recorded_at: Column) -> Column:
    """Content address of an operation: SHA-256 of its parts, each framed by its length."""
    framed = [F.concat(F.coalesce(F.octet_length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in (kind, fact_id, payload_hash, F.array_join(parents, ","), recorded_at)]
    return F.sha2(F.concat(*framed), 256)


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent by op_id: an operation that is there already isn't added again."""
    return log.unionByName(new.dropDuplicates(["op_id"]).join(log.select("op_id"), "op_id", "left_anti").select(*log.columns))


def missing_parents(log: DataFrame) -> DataFrame:
    """(op_id, parent) of parents that aren't in the log."""
    return log.select("op_id", F.explode("parents").alias("parent")).join(log.select(F.col("op_id").alias("parent")), "parent", "left_anti").select("op_id", "parent")


def monotone(rows: DataFrame, by: list[str], order: list[str], time: str) -> DataFrame:
    """Event times that strictly grow: what doesn't pass its predecessor becomes one microsecond more than it."""
    along = Window.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(along)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    top = F.max("_lead").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_place", place).withColumn("_lead", micros - F.col("_place")).withColumn(time, F.timestamp_micros(top + F.col("_place"))).drop("_place", "_lead")


def closure(edges: DataFrame, start: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(root, id): everything reachable along edges (src, dst) from start (root, id), itself included; cycles end by the visited set. Raises if that takes most_rounds, where given.

    A front that is few rows goes to the edges where they lie; a larger one meets them, and what was seen, by a sorted join, so no side of a round comes to the driver whole.
    """
    out = cut(edges.select(F.col("src").alias("id"), "dst"))
    front = cut(start.select("root", "id").distinct())
    seen = [front]
    for n in count():
        if n == most_rounds:
            raise RuntimeError(f"closure did not settle in {most_rounds} rounds")
        few = small(front, 20_000, 1 << 20)
        step = (few.join(out, "id") if few is not front else front.hint("merge").join(out, "id")).select("root", F.col("dst").alias("id")).distinct()
        found = reduce(DataFrame.unionByName, seen)
        front = cut(step.join(found.hint("merge"), ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        # what was seen is written anew only when it is in many pieces
        seen = [*seen, front] if len(seen) < 8 else [cut(found), front]
    return reduce(DataFrame.unionByName, seen)


def ancestry(log: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, id): operations that each head reaches through parents; heads (root, id)."""
    return closure(log.select(F.col("op_id").alias("src"), F.explode("parents").alias("dst")), heads)


def dependents(derivations: DataFrame, facts: DataFrame) -> DataFrame:
    """(root, id): facts derived from each of facts (id), directly or not, itself excluded."""
    found = closure(derivations.select(F.col("source_id").alias("src"), F.col("derived_id").alias("dst")), facts.select(F.col("id").alias("root"), "id"))
    return found.filter("root <> id")


def would_cycle(derivations: DataFrame, new: DataFrame) -> DataFrame:
    """New derivations (source_id, derived_id) whose source already depends on what is derived."""
    reach = closure(derivations.select(F.col("source_id").alias("src"), F.col("derived_id").alias("dst")), new.select(F.col("derived_id").alias("root"), F.col("derived_id").alias("id")))
    return new.join(reach.select(F.col("root").alias("derived_id"), F.col("id").alias("source_id")), ["derived_id", "source_id"], "left_semi")


def common_base(left: DataFrame, right: DataFrame, log: DataFrame) -> DataFrame:
    """(op_id): the common ancestors of two ancestries (id) that no other common ancestor descends from; one row, or merge bases are ambiguous."""
    common = left.select("id").intersect(right.select("id"))
    parents = log.join(common.select(F.col("id").alias("op_id")), "op_id", "left_semi").select(F.explode("parents").alias("id"))
    return common.join(parents, "id", "left_anti").select(F.col("id").alias("op_id"))


def replay(log: DataFrame, by: list[str] | None = None, snapshots: DataFrame | None = None, purged: DataFrame | None = None) -> DataFrame:
    """(by, fact_id, payload, seq): the state after all operations, the last one of each fact winning.

    snapshots (by, seq, fact_id, payload) are the states that merge and restore operations stand for: the latest
    replaces whatever was before it. One aggregation over the operations after it.
    """
    by = by or []
    whole = log.filter(F.col("kind").isin("merge", "restore")).groupBy(*by).agg(F.max("seq").alias("_cut"))
    events = log.filter(F.col("kind").isin("add", "update", "revert", "invalidate") & F.col("fact_id").isNotNull())
    if by:
        events = events.join(whole, by, "left")
    else:
        events = events.crossJoin(F.broadcast(whole))
    rows = events.filter("_cut is null or seq > _cut").select(*by, "fact_id", "seq", F.when(F.col("kind") != "invalidate", F.col("payload")).alias("payload"))
    if snapshots is not None:
        base = snapshots.join(whole.withColumnRenamed("_cut", "seq"), [*by, "seq"], "left_semi")
        rows = rows.unionByName(base.select(*by, "fact_id", "seq", "payload"))
    last = rows.groupBy(*by, "fact_id").agg(F.max_by(F.struct("payload", "seq"), "seq").alias("last")).select(*by, "fact_id", "last.payload", "last.seq").filter("payload is not null")
    return last if purged is None else last.join(purged.select("fact_id"), "fact_id", "left_anti").select(*last.columns)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(fact_id, change, before, after) between two states."""
    joined = left.select("fact_id", F.col("payload").alias("before")).join(right.select("fact_id", F.col("payload").alias("after")), "fact_id", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after"))).select("fact_id", change.alias("change"), "before", "after")


def state_digest(state: DataFrame, payload: Column) -> DataFrame:
    """(buckets, digest): one hash of a state, order-free: facts are hashed in 256 buckets by their own hash, then the buckets."""
    one = state.select(F.sha2(F.concat("fact_id", F.lit("\0"), payload), 256).alias("h"))
    each = one.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sum(F.conv(F.substring("h", 3, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("buckets"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", F.col("s").cast("string").alias("s"), "n"))), lambda x: F.concat_ws(":", x["b"], x["s"], x["n"].cast("string"))), ","), 256).alias("digest"))


def audit(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, fact_id, seq, before, after): payloads before and after each change."""
    along = Window.partitionBy(*(by or []), "fact_id").orderBy("seq")
    return log.withColumn("before", F.lag("payload").over(along)).filter("kind = 'update'").select(*(by or []), "fact_id", "seq", "before", F.col("payload").alias("after"))


def merge_preview(base: DataFrame, ours: DataFrame, theirs: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """(fact_id, payload, conflict, base, ours, theirs) of a three-way merge; states are (fact_id, payload), payloads without their recording time."""
    named = lambda df, n: df.select("fact_id", F.col("payload").alias(n))
    joined = named(base, "base").join(named(ours, "ours"), "fact_id", "full_outer").join(named(theirs, "theirs"), "fact_id", "full_outer")
    if purged is not None:
        joined = joined.join(purged.select("fact_id"), "fact_id", "left_anti")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    kind = F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "delete_update").otherwise("concurrent_update")
    payload = F.when(same("ours", "theirs"), F.col("ours")).when(same("ours", "base"), F.col("theirs")).when(same("theirs", "base"), F.col("ours"))
    conflict = F.when(~same("ours", "theirs") & ~same("ours", "base") & ~same("theirs", "base"), kind)
    return joined.select("fact_id", payload.alias("payload"), conflict.alias("conflict"), "base", "ours", "theirs")


def merge(preview: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """(fact_id, payload): the merged state. Conflicts need a resolution (fact_id, choice of ours, theirs, base or delete); others take none."""
    conflicts = preview.filter("conflict is not null")
    if resolutions is None:
        if not conflicts.isEmpty():
            raise ValueError("conflicts need resolutions")
        return preview.filter("payload is not null").select("fact_id", "payload")
    if not resolutions.join(conflicts, "fact_id", "left_anti").isEmpty():
        raise ValueError("resolution for a fact without conflict")
    if not resolutions.filter("choice is null or choice not in ('ours', 'theirs', 'base', 'delete')").isEmpty():
        raise ValueError("a resolution is ours, theirs, base or delete")
    if not conflicts.join(resolutions, "fact_id", "left_anti").isEmpty():
        raise ValueError("conflicts need resolutions")
    chosen = F.when(F.col("choice") == "ours", F.col("ours")).when(F.col("choice") == "theirs", F.col("theirs")).when(F.col("choice") == "base", F.col("base"))
    return preview.join(resolutions, "fact_id", "left").select("fact_id", F.when(F.col("conflict").isNotNull(), chosen).otherwise(F.col("payload")).alias("payload")).filter("payload is not null")


def anchor_states(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fact_id, symbol_id, state): fresh, stale or orphaned against the current hashes (id, hash)."""
    joined = anchors.join(symbols.select(F.col("id").alias("symbol_id"), F.col("hash").alias("_now"), F.lit(True).alias("_there")).hint("merge"), "symbol_id", "left")
    state = F.when(F.col("_there").isNull(), "orphaned").when(F.col("_now").eqNullSafe(F.col("content_hash")), "fresh").otherwise("stale")
    return joined.select("fact_id", "symbol_id", state.alias("state"))


def refresh(facts: DataFrame, anchors: DataFrame, symbols: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, anchors) after a new snapshot: a rename is followed if its target has the anchored hash; then any missing
    anchor orphans the fact and any differing one makes it stale. A fact never becomes fresh by itself, and rows that don't change stay as they are.
    Symbols, renames and states grow with the sources and are joined by sorting: as files they look small enough to broadcast when they aren't.

    facts (fact_id, freshness), anchors (fact_id, symbol_id, content_hash), symbols (id, hash), renames (old_id, new_id).
    """
    targets = renames.join(symbols.select(F.col("id").alias("new_id"), F.col("hash").alias("_to")).hint("merge"), "new_id").select(F.col("old_id").alias("symbol_id"), "new_id", "_to")
    moved = anchors.join(targets.hint("merge"), "symbol_id", "left").select("fact_id", F.when(F.col("_to") == F.col("content_hash"), F.col("new_id")).otherwise(F.col("symbol_id")).alias("symbol_id"), "content_hash")
    states = anchor_states(moved, symbols).groupBy("fact_id").agg(F.bool_or(F.col("state") == "orphaned").alias("_gone"), F.bool_or(F.col("state") == "stale").alias("_old"))
    fresh = F.when(F.col("_gone"), "orphaned").when(F.col("_old"), "stale").otherwise(F.col("freshness"))
    return facts.join(states.hint("merge"), "fact_id", "left").select("fact_id", fresh.alias("freshness")), moved


def refresh_after(facts: DataFrame, anchors: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What runs after each index: symbols (id, content_hash) of the snapshots before and after give the renames, which `refresh` follows."""
    gone = before.join(after.select("id").hint("merge"), "id", "left_anti")
    new = after.join(before.select("id").hint("merge"), "id", "left_anti")
    return refresh(facts, anchors, after.select("id", F.col("content_hash").alias("hash")), renames(gone, new))


def revalidate(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Anchors with the current hashes; a deleted anchor raises."""
    joined = anchors.join(symbols.select(F.col("id").alias("symbol_id"), F.col("hash").alias("_now")), "symbol_id", "left")
    return joined.select("fact_id", "symbol_id", F.when(F.col("_now").isNull(), F.raise_error(F.lit("anchor is deleted"))).otherwise(F.col("_now")).alias("content_hash"))


def contradictions(facts: DataFrame) -> DataFrame:
    """(fact_id, other_id): facts of one subject with different texts. As many rows as there are such pairs; `contested` says which subjects have any, one row each."""
    named = facts.filter("subject is not null and subject <> ''").select("fact_id", "subject", "text")
    other = named.select(F.col("fact_id").alias("other_id"), "subject", F.col("text").alias("_text"))
    return named.join(other, "subject").filter("text <> _text").select("fact_id", "other_id")


def contested(facts: DataFrame) -> DataFrame:
    """(subject, texts, facts): subjects about which facts differ, with the numbers of texts and facts."""
    named = facts.filter("subject is not null and subject <> ''")
    return named.groupBy("subject", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("facts")).filter("texts > 1")


def preferred(facts: DataFrame, priority: dict[str, int] = SOURCE_PRIORITY) -> DataFrame:
    """(subject, fact_id): the belief that wins: by source, then what is valid later, recorded later, stored later, more certain, greater id."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv)), F.coalesce("source", F.lit(""))), F.lit(0))
    key = F.struct(rank.alias("p"), "valid_from", "recorded_at", "row", "confidence", "fact_id")
    return facts.groupBy("subject").agg(F.max_by("fact_id", key).alias("fact_id"))


def contains(start: Column, end: Column, point: Column) -> Column:
    """Half-open; a null end is open."""
    return (start <= point) & (end.isNull() | (point < end))


def as_of(timeline: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """Rows valid at one time as believed at another."""
    return timeline.filter(contains(F.col("valid_from"), F.col("valid_to"), valid_at) & contains(F.col("tx_from"), F.col("tx_to"), known_at))


def timeline_simple(log: DataFrame, by: str = "fact_id") -> DataFrame:
    """The bitemporal rows of logs whose corrections only move forward in valid time, with windows alone.

    log (fact_id, valid_from, recorded_at, seq, payload), each with an open end. A correction closes its predecessor's
    belief and repeats it up to its own valid_from.
    """
    along = Window.partitionBy(by).orderBy("seq")
    ahead = log.withColumn("_at", F.lead("recorded_at").over(along)).withColumn("_valid", F.lead("valid_from").over(along))
    opened = ahead.select(by, "payload", "valid_from", F.lit(None).cast(log.schema["valid_from"].dataType).alias("valid_to"), F.col("recorded_at").alias("tx_from"), F.col("_at").alias("tx_to"))
    kept = ahead.filter("_valid > valid_from").select(by, "payload", "valid_from", F.col("_valid").alias("valid_to"), F.col("_at").alias("tx_from"), F.lit(None).cast(log.schema["recorded_at"].dataType).alias("tx_to"))
    return opened.unionByName(kept)


def fold_timeline(operations: list[tuple]) -> list[list]:
    """Bitemporal rows [payload, valid_from, valid_to, tx_from, tx_to] of one fact's operations in order.

    operations (kind, payload, valid_from, valid_to, at), with snapshot operations among them: a snapshot retires
    all and, if it holds the fact, asserts it again. Times compare as given; None is open.
    """
    rows: list[list] = []

    def overlaps(a, b, c, d) -> bool:
        return (b is None or c < b) and (d is None or a < d)

    def retire(at, keep_past: bool) -> None:
        for row in list(rows):
            if row[4] is None:
                row[4] = at
                end = at if row[2] is None else min(row[2], at)
                if keep_past and row[1] < end:
                    rows.append([row[0], row[1], end, at, None])

    def correct(payload, start, end, at) -> None:
        for row in list(rows):
            if row[4] is not None or not overlaps(row[1], row[2], start, end):
                continue
            if at <= row[3]:
                raise ValueError("corrections must advance transaction time")
            row[4] = at
            if row[1] < start:
                rows.append([row[0], row[1], start, at, None])
            if end is not None and (row[2] is None or end < row[2]):
                rows.append([row[0], end, row[2], at, None])
        rows.append([payload, start, end, at, None])

    for kind, payload, start, end, at in operations:
        if kind == "snapshot":
            retire(at, False)
            if payload is not None:
                correct(payload, start, end, at)
        elif kind == "invalidate":
            retire(at, True)
        elif payload is not None:
            correct(payload, start, end, at)
        elif kind == "revert":
            retire(at, False)
    return rows


def timeline(log: DataFrame) -> DataFrame:
    """(fact_id, payload, valid_from, valid_to, tx_from, tx_to) of any log: each fact's operations are folded in order.

    log (fact_id, seq, kind, payload string, valid_from, valid_to, recorded_at); snapshots appear as rows of kind 'snapshot' for each fact
    they end or hold. A task holds one fact's operations at a time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values("seq")
        none = lambda x: None if pd.isna(x) else x
        rows = fold_timeline([(k, none(p), none(a), none(b), t) for k, p, a, b, t in zip(pdf.kind, pdf.payload, pdf.valid_from, pdf.valid_to, pdf.recorded_at)])
        out = pd.DataFrame(rows, columns=["payload", "valid_from", "valid_to", "tx_from", "tx_to"])
        out.insert(0, "fact_id", key[0])
        for c in ("valid_from", "valid_to", "tx_from", "tx_to"):
            out[c] = pd.to_datetime(out[c])
        yield out

    wanted = log.select("fact_id", "seq", "kind", "payload", *(F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to", "recorded_at")))
    return wanted.groupBy("fact_id").applyInPandas(run, "fact_id string, payload string, valid_from timestamp_ntz, valid_to timestamp_ntz, tx_from timestamp_ntz, tx_to timestamp_ntz")


def rank_recall(facts: DataFrame, query: DataFrame | None = None, include_stale: bool = True) -> DataFrame:
    """Facts in the order of recall: freshness, score, confidence, id. With a query (query_id, query) only those that match.

    facts (fact_id, anchors_text, subject, text, freshness, confidence).
    """
    shown = facts if include_stale else facts.filter("freshness = 'fresh'")
    order = F.element_at(F.create_map(*(F.lit(x) for x in ("fresh", 0, "stale", 1, "orphaned", 2))), F.col("freshness"))
    if query is None:
        scored = shown.withColumn("query_id", F.lit(0)).withColumn("score", F.lit(0.0))
    else:
        docs = shown.select("fact_id", F.coalesce("anchors_text", F.lit("")).alias("signature"), F.coalesce("subject", F.lit("")).alias("docstring"), F.col("text").alias("body"))
        scored = shown.join(search(docs, query, "fact_id", ["signature", "docstring", "body"], "query_id", "query", None).select("query_id", F.col("id").alias("fact_id"), "score"), "fact_id")
    along = Window.partitionBy("query_id").orderBy(order, F.round("score", 9).desc(), F.desc("confidence"), "fact_id")
    return scored.withColumn("place", F.row_number().over(along))


def forget(tables: dict[str, DataFrame], derivations: DataFrame, facts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, tombstones): every table with fact_id rewritten without the facts (id) and all that derives from them."""
    gone = closure(derivations.select(F.col("source_id").alias("src"), F.col("derived_id").alias("dst")), facts.select(F.col("id").alias("root"), "id")).select(F.col("id").alias("fact_id")).distinct()
    return {name: df.join(gone, "fact_id", "left_anti").select(*df.columns) for name, df in tables.items()}, gone


def select_by(blobs: DataFrame, session: str | None = None, source: str | None = None) -> DataFrame:
    """(id) of facts that any stored payload (fact_id, session, source) ties to the session and the source."""
    if session is None and source is None:
        raise ValueError("name a session or a source")
    match = F.lit(True)
    for column, value in (("session", session), ("source", source)):
        if value is not None:
            match = match & (F.col(column) == value)
    return blobs.filter(match).select(F.col("fact_id").alias("id")).distinct()


def summaries(facts: DataFrame, by: str, generate=lambda texts: F.array_join(texts, " "), least: int = 2) -> DataFrame:
    """(by, text, confidence, derived_from): one summary of the fresh facts of each group with several; `generate` is a column function of their texts in order of id."""
    fresh = facts.filter("freshness = 'fresh'").dropDuplicates(["fact_id"])
    groups = fresh.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("fact_id", "text"))).alias("f"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return groups.select(by, generate(F.transform("f", lambda x: x["text"])).alias("text"), "confidence", F.transform("f", lambda x: x["fact_id"]).alias("derived_from"))
