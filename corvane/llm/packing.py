"""Best-fit packing under conflicts.

Documents longer than a bin are cut into pieces of whole bins and a rest. Pieces are dealt to
shards of about `shard_rows` by a hash of id, text and piece, so a source or cluster with a third of all rows is spread evenly and a shard's
size is bounded whatever the corpus; each shard packs its pieces by best fit, the longest first. Open bins are
ordered by residual room and carry a bitmap of the sources and one of the duplicate clusters
they hold: no bin takes two pieces of one source or one cluster.

Clusters hold copies and near copies: texts whose words are equal, case aside, and texts that agree in one of BANDS bands of
MINIMA least hashes of their five-word shingles. Of pairs with a similarity of 0.8, one in 4,600 agrees in none; pairs of lesser similarity
may agree too (0.5: two in three, 0.3: one in eight) and are then kept apart as well, which is a conflict too many, never one too few.
A text is in several clusters at once, so no pairs are made and no components are needed. The search for a piece begins at the
tightest residual that fits and goes on through the successors until a bin is compatible; residuals
at which every bin holds the piece's source are passed over by count. Only if none is left is a bin opened.

Defined cases: a text without words (or null) gets one row with no bin. A null source counts as a source of its own. Repeated rows
are pieces of their own and, being of one cluster, never share a bin; where they are many they are dealt to shards by their place in the table. Equal lengths are ordered by
a hash of id and piece, then id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, map_batches, small, text_list

CAPACITY, SHARD_ROWS = 2048, 20_000
SHINGLE, BANDS, MINIMA = 5, 16, 4


class Bins:
    """Open and full bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]  # residual -> source bitmap -> bins
        self.count = np.zeros(capacity + 1, np.int64)
        self.holding: dict[int, np.ndarray] = {}  # source bit -> at each residual, bins that hold it
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.places: list[int] = []

    def find(self, n: int, source: int, cluster: int) -> int | None:
        """The tightest compatible bin; source and cluster are bits (0: in conflict with none)."""
        free = self.count[n:]
        if source in self.holding:
            free = free - self.holding[source][n:]
        for r in np.flatnonzero(free > 0):
            for held, bins in self.at[n + int(r)].items():
                if not held & source:
                    for b in bins:
                        if not self.clusters[b] & cluster:
                            return b
        return None

    def put(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) of a piece."""
        b = self.find(n, source, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.places.append(0)
        else:
            self._move(b, -1)
        self.residual[b] -= n
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.places[b] += 1
        self._move(b, 1)
        return b, self.places[b] - 1

    def _move(self, b: int, by: int) -> None:
        r, held = self.residual[b], self.sources[b]
        if not r:
            return  # full
        self.count[r] += by
        group = self.at[r].setdefault(held, {})
        if by > 0:
            group[b] = None
        else:
            del group[b]
            if not group:
                del self.at[r][held]
        while held:
            bit = held & -held
            held ^= bit
            if bit not in self.holding:
                self.holding[bit] = np.zeros(self.capacity + 1, np.int64)
            self.holding[bit][r] += by


def bitmaps(groups: Sequence[Sequence]) -> list[int]:
    """For the groups that each piece belongs to, a bitmap with a bit for each group of two pieces or more; groups of the same pieces have one bit.

    Groups are sorted as one flat array, and only those of several pieces become Python objects.
    """
    rows = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    flat = np.concatenate([np.asarray(g) for g in groups]) if len(groups) else np.zeros(0, np.int64)
    numbers = np.unique(flat, return_inverse=True)[1]
    order = np.lexsort((rows, numbers))
    ends = np.flatnonzero(np.diff(numbers[order], append=-1)) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    several = ends - starts > 1
    out = [0] * len(groups)
    members = {tuple(dict.fromkeys(rows[order[x:y]].tolist())) for x, y in zip(starts[several], ends[several])}
    for bit, pieces in enumerate(sorted(m for m in members if len(m) > 1)):
        for i in pieces:
            out[i] |= 1 << bit
    return out


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds bin, place and bin_words to the pieces of a shard (doc_id, key, groups, piece, n); the first group is that of equal texts."""
    names = [f"{d}:{p}" for d, p in zip(pdf.doc_id.astype("object").where(pdf.doc_id.notna(), "null"), pdf.piece)]
    pdf = pdf.assign(at=[hashlib.blake2b(x.encode(), digest_size=8).hexdigest() for x in names], copy=[int(g[0]) for g in pdf.groups])
    pdf = pdf.sort_values(["n", "at", "doc_id", "key", "copy"], ascending=[False, True, True, True, True], kind="stable")
    bins = Bins(capacity)
    # the bitmaps have any number of bits, so they stay outside the frame
    put = [bins.put(int(n), s, c) for n, s, c in zip(pdf.n, bitmaps([[k] for k in pdf["key"]]), bitmaps(list(pdf.groups)))]
    return pdf.assign(bin=[b for b, _ in put], place=[p for _, p in put], bin_words=[capacity - bins.residual[b] for b, _ in put])


_ODD = np.random.default_rng(17).integers(1 << 63, size=BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(18).integers(1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def copy_groups(tokens: list[bytes]) -> list[int]:
    """The groups that a text of these words may share with near copies: the hash of all words, and one for each band of least shingle hashes."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    whole = xxhash.xxh64_intdigest(each.tobytes(), 1)
    n = max(1, len(each) - SHINGLE + 1)
    if len(each) >= SHINGLE:
        shingles = np.zeros(n, np.uint64)
        for i, m in enumerate(_MIX):
            shingles += each[i : n + i] * m
    else:
        shingles = np.array([whole], np.uint64)
    shingles ^= shingles >> np.uint64(29)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, n, 1 << 12):
        values = shingles[start : start + (1 << 12), None] * _ODD
        np.minimum(least, values.min(axis=0), out=least)
    bands = least.reshape(BANDS, MINIMA)
    return [int(x) - (1 << 63) for x in (whole, *(xxhash.xxh64_intdigest(b.tobytes(), 2 + i) for i, b in enumerate(bands)))]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, groups) of every row; all that packing needs to know of a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = {}  # rows of further epochs repeat a text
        for text in (texts := text_list(batch)):
            if text not in known:
                tokens = text.lower().encode("utf-8", "surrogatepass").split()
                known[text] = len(tokens), copy_groups(tokens)
        columns = [pa.array((known[t][k] for t in texts), kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), *columns], ["doc_id", "key", "size", "groups"])

    keyed = docs.select("doc_id", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("key"), "text")
    return map_batches(keyed, run, "doc_id long, key string, size long, groups array<long>")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin_id, place, bin_words) for the pieces of every row."""
    sized = cut(measured(docs))
    text = F.get("groups", F.lit(0))
    n_pieces = sized.agg(F.coalesce(F.sum(F.ceil(F.col("size") / capacity)), F.lit(0)).cast("long")).first()[0]
    shards = max(1, -(-n_pieces // shard_rows))
    # rows that repeat an id and a text more often than a shard should hold are dealt out by their place in the table
    often = cut(sized.groupBy("doc_id", text.alias("copy")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, shard_rows // 20)).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")))
    salt = F.when(F.col("_copy").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    salted = sized.join(small(often), F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_copy")), "left").withColumn("salt", salt).drop("_id", "_copy")
    pieces = salted.select("doc_id", "key", "groups", "size", "salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int")))).alias("piece"))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity))
    shard = F.pmod(F.xxhash64("doc_id", text, "piece", "salt", F.lit("shard")), F.lit(shards)).cast("int")
    schema = "doc_id long, piece int, start_word long, n_words long, bin_id long, place int, bin_words long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf, capacity)
        return pd.DataFrame({"doc_id": out.doc_id, "piece": out.piece, "start_word": out.piece.astype("int64") * capacity, "n_words": out.n.astype("int64"), "bin_id": (int(key[0]) << 32) + out.bin.astype("int64"), "place": out.place.astype("int32"), "bin_words": out.bin_words.astype("int64")})

    packed = pieces.filter("n > 0").select("doc_id", "key", "groups", "piece", "n", shard.alias("shard")).groupBy("shard").applyInPandas(run, schema)
    empty = sized.filter("size = 0").selectExpr("doc_id", "0 piece", "0L start_word", "0L n_words", "cast(null as long) bin_id", "cast(null as int) place", "0L bin_words")
    return packed.unionByName(empty)
