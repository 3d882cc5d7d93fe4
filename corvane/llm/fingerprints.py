"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's fingerprint holds the k least hashes of its distinct five-word shingles, ascending, as
hexadecimal digits of equal width. Two sketches merge by keeping the k least of both, so a
sketch of a part, a document or a whole corpus is made in the same way, whatever the split. Everything is native:
arrays of hashes inside the scan, no exploded shingles, no Python.

Defined cases: a null text is empty; an empty text has the empty fingerprint, alike to another
empty one (1.0) and unlike all others (0.0). A text under five words is one shingle. Equal ids are ordered by a hash of the text, so
an id that many rows share is spread over many blocks; only rows with equal id and text are in one. Any long is an id, however far
apart. A null id comes last. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.common import cut, small, words

SHINGLE, K, DIGITS = 5, 128, 12
#: Documents are put in order in blocks of about so many rows; with so many blocks at most, their bounds are a table of bounded size.
BLOCK_ROWS, MOST_BLOCKS = 128, 50_000
#: Rows of the sample for each bound: they decide how even blocks are, never a result.
BOUND_ROWS = 20


def hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """One hash for each shingle, repeats included: 48 bits of a hash over the words' hashes."""
    top = F.lit(1 << (4 * DIGITS)) - 1

    def from_words(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))
        window = lambda one: F.aggregate(one, F.struct(each.alias("h")), lambda a, _: a, lambda a: F.transform(F.slice(a["h"], 1, F.greatest(F.size(a["h"]) - shingle + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(a["h"], i + j) for j in range(1, shingle))).bitwiseAND(top)))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")).bitwiseAND(top))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) < shingle, short).otherwise(window(F.array(F.lit(0))))

    return from_words(words(text))


def least(values: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The fingerprint as an array of longs."""
    return least(hashes(text, shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(rows: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(by, sketch): the sketches of each group merged. Hashes are ranked after a partial distinct, salted so that a hot group is spread first."""
    each = rows.select(*by, F.explode("sketch").alias("h"), F.pmod(F.xxhash64("sketch"), F.lit(64)).alias("salt")).distinct()
    near = each.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("h"))).filter(F.col("r") <= k).select(*by, "h").distinct()
    final = near.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= k)
    return final.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def n_distinct(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * F.lit(float(1 << (4 * DIGITS))) / F.get(s, F.lit(k - 1)))


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    union = merge(a, b, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double"), F.size(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the shared part of the union's k least hashes."""
    shared, n = _shared(a, b, k)
    return F.when(n == 0, 1.0).otherwise(shared / F.greatest(n, F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null if a is empty."""
    shared, n = _shared(a, b, k)
    both = shared / F.greatest(n, F.lit(1)) * n_distinct(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), both / F.greatest(n_distinct(a, k), F.lit(1.0))))


def as_text(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), DIGITS, "0")), ""))


def _order(text: str) -> list[Column]:
    """The columns of the order of documents: descending id, null last, then a hash of the text. No arithmetic on ids, so any long will do."""
    return [F.col("doc_id").isNull().alias("bare"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64(text).alias("tie")]


def _bounds(keys: DataFrame, n: int, block_rows: int, most_blocks: int) -> list:
    """Keys at which blocks of about equal numbers of rows begin, ascending; from a sample by hash that holds a bounded number of rows."""
    blocks = min(most_blocks, -(-n // block_rows))
    if blocks < 2:
        return []
    every = max(1, n // (BOUND_ROWS * blocks))
    seen = cut(keys.filter(F.pmod(F.xxhash64("bare", "down", "tie", F.lit("bound")), F.lit(every)) == 0).distinct())
    m = seen.count()
    place = F.row_number().over(Window.orderBy("bare", "down", "tie"))
    step = max(1, -(-m // blocks))
    return seen.withColumn("at", place).filter((F.col("at") % step == 0) & (F.col("at") < m)).select("bare", "down", "tie").orderBy("bare", "down", "tie").collect()


def _block(bounds: list) -> Column:
    """The number of bounds at or below the row's key, by halving: the bounds lie one after another in a constant of bytes that compare as keys do."""
    if not bounds:
        return F.lit(0).cast("long")
    table = F.lit(bytearray(b"".join(struct.pack(">?QQ", r[0], r[1] + (1 << 63), r[2] + (1 << 63)) for r in bounds)))
    wide = struct.calcsize(">?QQ")
    unsigned = lambda c: F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.unhex(F.concat(F.when(F.col("bare"), "01").otherwise("00"), unsigned("down"), unsigned("tie")))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def found(own: Column) -> Column:
        reached = lambda n: (n <= len(bounds)) & (F.substring(table, (n - 1) * wide + 1, F.lit(wide)) <= own)
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(reached(n + step), n + step).otherwise(n))

    # through an array of one, so that the key is made once a row
    return F.get(F.transform(F.array(key), found), F.lit(0)).cast("long")


def with_next(docs: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda rows: rows, columns: tuple[str, ...] = ("text",), block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows (doc_id, text) in what `made` makes of them, with next_<column> of the next row by descending doc_id (after the last, the first).

    The order is cut into blocks of about equal numbers of rows, whatever the ids: keys (id and a hash of the text) are written once,
    bounds are taken from a sample of them. The first row of each block is also handed to the block before it, so a window within blocks
    finds every next row. Texts are shuffled once; `made` runs behind that shuffle, so what it makes isn't shuffled.
    """
    keyed = docs.select("doc_id", "text", *_order("text"))
    keys = cut(keyed.select("bare", "down", "tie"))
    bounds = _bounds(keys, keys.count(), block_rows, most_blocks)
    block = _block(bounds)
    heads = keys.withColumn("block", block).groupBy("block").agg(F.min(F.struct("bare", "down", "tie")).alias("head"))
    # one row a block
    order = Window.orderBy("block")
    last = F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    handed = heads.select(F.col("block").alias("_own"), "head", F.coalesce(F.lag("block").over(order), last).alias("_to"))
    joined = keyed.withColumn("_own", block).join(small(handed, len(bounds) + 1), "_own")
    places = F.array(F.struct(F.col("_own").alias("block"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("block"), F.lit(True).alias("guest")))
    is_head = F.struct("bare", "down", "tie") == F.col("head")
    spread = joined.select("doc_id", "text", "bare", "down", "tie", F.explode(F.when(is_head, places).otherwise(F.slice(places, 1, 1))).alias("_place")).select("doc_id", "text", "bare", "down", "tie", "_place.*")
    rows = made(spread.repartition("block"))
    along = Window.partitionBy("block").orderBy("guest", "bare", "down", "tie")
    ahead = [F.lead(F.struct(c)).over(along).alias(f"_next_{c}") for c in columns]
    kept = [c for c in rows.columns if c not in ("bare", "down", "tie", "block", "guest")]
    found = rows.select(*kept, "guest", *ahead).filter("not guest")
    return found.select(*kept, *(F.col(f"_next_{c}.{c}").alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Each row's fingerprint, and that of its edited text: the last third replaced by the beginning of the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = with_next(texts, lambda rows: rows.withColumn("sketch", sketch(F.col("text"), k)), ("text", "sketch"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = made.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("*", sketch(F.col("edited"), k).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
        n_distinct(F.col("sketch"), k).alias("n_shingles"),
    )
