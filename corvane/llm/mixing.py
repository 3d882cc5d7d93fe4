"""Mixing sources to target weights.

Every document gets a hash-random key; keys are cut into equal ranges within each source, so a
source with a third of all rows is spread over all ranges. Words are summed per range, the range
sums are accumulated within the source, and a running sum within the range completes each
document's position. A source that reaches its target several times repeats whole epochs; the
last, partial epoch ends at the exact word of the budget.

Defined cases: a null text has no words; a null source is a source of its own, last in order. A
source without words has target 0. Repeated rows are documents of their own (ties of the key are
ordered by size; rows equal in both may swap places, which changes nothing but their own
taken). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.common import cut, n_words

WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Documents of a source in one range, about.
RANGE_ROWS = 20_000


def source_key(source: Column) -> Column:
    """A key without nulls, in code point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(key, source_size, target) for a table (key, source_size) of one row a source.

    The targets share `share` of all words by weight; what exceeds `most` times a source's words is shared
    again among the others until none exceeds. That ends where a level x gives every source
    the lesser of weight * x and its limit; the level follows from sources in the order of limit / weight.
    The two sorts are over one row a source.
    """
    rank = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int"))
    ranked = sizes.select("key", "source_size", weight.alias("w")).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), "key")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("w").over(onward)
    levels = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level")))
    # levels fall along the order once they are possible, so the first possible one is the greatest
    first = F.coalesce(F.max("level").over(everything), F.lit(float("inf")))
    return levels.withColumn("x", first).select("key", "source_size", F.least("limit", F.col("w") * F.col("x")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; with keep also the input's columns, in a struct `_row`."""
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")), 256)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if keep else []
    sized = docs.select("doc_id", source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), F.substring(digest, 1, 16).alias("at"), *row)
    # texts are read once for the sizes, which are a small table; rows that are kept whole are read once more
    sizes = cut(sized.select("doc_id", "key", "size", "at"))
    sized = sized if keep else sizes
    per_source = cut(sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    aimed = targets(per_source.select("key", "source_size"), weights, share, most)
    biggest = per_source.agg(F.max("n")).first()[0] or 0
    ranges = 1
    while ranges * range_rows < biggest and ranges < 1 << 28:
        ranges *= 2
    bucket = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
    placed = sized.withColumn("bucket", bucket)
    sums = sizes.withColumn("bucket", bucket).groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("key", "bucket", before.alias("before")).join(aimed, "key")
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = placed.withColumn("inside", inside).join(offsets, ["key", "bucket"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("before") + F.col("inside") - F.col("size"))))
    taken = (epochs * F.col("size") + part).cast("long").alias("taken")
    return run.select("doc_id", "size", "source_size", "target", taken, *(["_row"] if keep else []))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each epoch of a document, all columns kept; at the cut the text ends with the last word of the budget.

    A document without words isn't part of any mix.
    """
    found = mix(docs, weights, share, most, seed, keep=True)
    whole = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(0)
    rest = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = found.select("_row", "size", F.explode(copies).alias("words"))
    blank = r"[\x20\x09-\x0D]+"
    text = F.col("_row.text")
    parts = F.split(text, blank, (F.col("words") + 1 + F.rlike(text, F.lit("^" + blank)).cast("int")).cast("int"))
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1))), blank + "$", "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(text)
    cutted = rows.withColumn("_text", text)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("words") < F.col("size"), F.length("_text").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars"))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return cutted.select(*out)
