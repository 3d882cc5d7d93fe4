"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. If two fingerprints differ in at most four
bits, at least four of their bytes agree in place. An index on single bytes would have lists
of N/256 fingerprints, so a posting list here stands for three positions at once: the 20
position triples of TRIPLES meet every choice of four positions, hence every pair that shares
four positional bytes shares a list of about N/2^24. Within a list the shared positional
bytes of each pair are tallied, pairs below the guaranteed minimum are dropped, and the rest
are verified by counting differing bits. Nothing is capped; a list beyond `hot` fingerprints, which would be quadratic, is
searched by flipping up to two of its 40 free bits on either side, which is linear in the list and finds the same links.
Near copies that differ in more than four bits are no links.

Defined cases: a null or empty text has fingerprint zero, linked like any other. Equal
fingerprints collapse before the index, so copies cost one key. A null doc_id counts as larger than any id
(component_id is null only if a component has no id). Repeated rows get the same result each.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, map_batches, small, text_list
from corvane.llm.graph import components

SHINGLE, BITS, LINK_BYTES = 4, 4, 4
#: Fingerprints in a posting list above which pairs are found by bit flips.
HOT = 8192

_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES: list[tuple[int, int, int]] = sorted(
    [g for g in _GROUPS if len(g) == 3]
    + [tuple(sorted((*pair, one))) for i, g in enumerate(_GROUPS) for pair in combinations(g, 2) for one in _GROUPS[(i + 1) % 3]]
)


def fingerprint(text: str) -> int:
    """The simhash of one text, unsigned."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(SHINGLE)))) if len(tokens) > SHINGLE else [b" ".join(tokens)]
    values = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(values), 255):  # sums of so many bits fit in bytes
        counts += np.unpackbits(values[start : start + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([_signed(fingerprint(x)) for x in text_list(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), values], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def linked_in_list(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one posting list: as many edges as connectivity needs, not all pairs."""
    left, right, rest = [], [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            differ = rest ^ one
            shared = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1)
            near = np.flatnonzero(shared >= LINK_BYTES)
            near = near[np.bitwise_count(differ[near]) <= BITS]
            if len(near):
                found = rest[near]
                left.append(np.full(len(found), one))
                right.append(found)
                queue.extend(found)
                rest = np.delete(rest, near)
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _byte_mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (56 - 8 * p) for p in positions))


def _free_bits() -> list[list[int]]:
    """For each triple, no bit and the single bits outside it; two of these make each mask of at most two flips."""
    return [[0, *(_signed(1 << (63 - b)) for b in range(64) if b // 8 not in triple)] for triple in TRIPLES]


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between different fingerprints, enough to connect whatever is linked."""
    keyed = fps.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(i).alias("triple"), F.col("fp").bitwiseAND(F.lit(_byte_mask(t))).alias("bytes")) for i, t in enumerate(TRIPLES)))).alias("key"),
    ).select("fp", "key.*")
    # lists are counted by aggregation first, so a list of a third of all fingerprints is never in one task
    hot_lists = cut(keyed.groupBy("triple", "bytes").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("triple", "bytes"))
    is_hot = small(hot_lists)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("fps")
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        twos = offsets[:-1][sizes == 2]
        differ = flat[twos] ^ flat[twos + 1]
        shared = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1)
        good = twos[(shared >= LINK_BYTES) & (np.bitwise_count(differ) <= BITS)]
        left, right = [flat[good]], [flat[good + 1]]
        for start, size in zip(offsets[:-1][sizes > 2], sizes[sizes > 2]):
            a, b = linked_in_list(flat[start : start + size])
            left.append(a)
            right.append(b)
        pairs = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    lists = keyed.join(is_hot, ["triple", "bytes"], "left_anti").groupBy("triple", "bytes").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    found = map_batches(lists, run, "a long, b long")
    bits = F.get(F.array(*(F.array(*map(F.lit, x)) for x in _free_bits())), F.col("triple"))
    pairs = F.explode(F.expr("concat(array(struct(0 as i, 0 as j)), flatten(transform(sequence(1, 40), j -> transform(sequence(0, j - 1), i -> struct(i, j)))))"))
    flipped = keyed.join(is_hot, ["triple", "bytes"], "left_semi").select("triple", "fp", bits.alias("bits"), pairs.alias("p"))
    flipped = flipped.select("triple", "fp", F.col("fp").bitwiseXOR(F.get("bits", F.col("p.i"))).bitwiseXOR(F.get("bits", F.col("p.j"))).alias("variant"))
    least = flipped.groupBy("triple", "variant").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = flipped.join(least, ["triple", "variant"]).select(F.col("fp").alias("a"), "b").filter("a <> b")
    return found.unionByName(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: root is the component's least fingerprint."""
    marked = cut(fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(cut(links(distinct.select("fp"), hot)))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row."""
    return classes(docs, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that of the least doc_id (null last), of several such rows that of the least hash of the text.

    Rows are told apart by doc_id and a hash of the text, so repeated rows count as one, and texts that share an id stay apart.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([_signed(fingerprint(x)) for x in text_list(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), values], ["doc_id", "th", "fp"])

    marked = cut(map_batches(named, run, "doc_id long, th long, fp long"))
    # the best row of each fingerprint first, so a fingerprint of a third of all rows is one row of the join
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "th")).alias("row"))
    roots = components(cut(links(best.select("fp"))))
    least = best.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row"))
    keys = least.select(F.coalesce("row.doc_id", F.lit(0)).alias("_corvane_id"), F.col("row.bare").alias("_corvane_bare"), F.col("row.th").alias("_corvane_th"))
    keyed = docs.withColumns({"_corvane_id": F.coalesce("doc_id", F.lit(0)), "_corvane_bare": F.col("doc_id").isNull(), "_corvane_th": F.xxhash64("text")})
    kept = keyed.join(keys, ["_corvane_id", "_corvane_bare", "_corvane_th"], "left_semi").dropDuplicates(["_corvane_id", "_corvane_bare", "_corvane_th"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
