"""Toxicity by class-conditional Kneser-Ney models.

The models predict the bytes of each word from the bytes before it (order 5), so inflected and
misspelt forms share the statistics of their stems. Each class (toxic, ordinary) has its own
discounted counts at the highest order; below it both share one Kneser-Ney backoff made of
continuation counts over both classes, so a rare expression that neither class has seen favours
neither. A word's evidence is its log-likelihood under the toxic model less that under
the ordinary one, as far as it exceeds DEAD nats: less is the noise of estimates, and ordinary words
say nothing, as toxic texts are mostly made of them (one German insult isn't less of one for the German around it).
Evidence is summed and divided by the number of words (plus PRIOR_WORDS), and a logistic
curve turns this into a score.

Counts cover all labelled rows of the learning folds (crc32 of the id modulo 5 is 1, 2 or 3); fold 4 fits the
curve, on at most `calibration_rows` rows (the least by hash of the id); fold 0 is held out. Counts are kept per byte
sequence, not per word, and none is dropped. Up to `most_grams` sequences the model is made on the driver;
beyond that the same model is two tables, made by aggregation. Up to BROADCAST_ROWS sequences either is broadcast as flat arrays
of keys and values (16 bytes a sequence); beyond that the tables are joined to the distinct words of
the texts, so the model's size bounds no memory and decides no result.

Defined cases: a null or empty text has no evidence and gets the curve's value at 0. Rows with
null ids or labels aren't learned from (a null id isn't held out either); an id with several labels counts as toxic if any says so. Without any toxic or any ordinary
row every score is 0.25. Repeated rows are learned from as often as they occur and are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import BROADCAST_ROWS, cut, map_arrow, map_batches, n_words, sliced, small, text_list

ORDER, DISCOUNT, DEAD, PRIOR_WORDS, MOST_WORD = 5, 0.75, 2.5, 30, 64
#: Sequences up to which the model is made on the driver; beyond it, by aggregation.
MOST_GRAMS = 400_000
#: Distinct words that a task counts before it passes on their sequences.
MOST_HELD = 100_000
#: Words whose sequences are arrays at once.
WORDS_AT_ONCE = 8_192
CALIBRATION_ROWS = 20_000
FOLDS, CALIBRATION_FOLD = 5, 4


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def grams(word: bytes, order: int = ORDER) -> list[bytes]:
    """The byte sequence that ends at each byte of the marked word; words beyond MOST_WORD bytes fall into pieces."""
    out = []
    for start in range(0, len(word), MOST_WORD):
        marked = b"\x01" + word[start : start + MOST_WORD] + b"\x02"
        out += [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]
    return out


def sequence_keys(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the `grams` of all words, and how many each word has; WORDS_AT_ONCE together, as words are mostly new ones.

    A key is a sequence's bytes as a number, with its length in the highest byte; sequences are of seven bytes at most.
    """
    if len(words) > WORDS_AT_ONCE:
        parts = [sequence_keys(words[i : i + WORDS_AT_ONCE], order) for i in range(0, len(words), WORDS_AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pieces, n_pieces = words, np.minimum(lengths, 1)
    if len(words) and lengths.max() > MOST_WORD:
        pieces, n_pieces = [w[i : i + MOST_WORD] for w in words for i in range(0, len(w), MOST_WORD)], -(-lengths // MOST_WORD)
    elif len(words) and not lengths.min():
        pieces = [w for w in words if w]
    counts = lengths + n_pieces
    if not pieces:
        return np.zeros(0, np.uint64), counts
    data = np.frombuffer(b"\x01" + b"\x02\x01".join(pieces) + b"\x02", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    keys = data | (np.minimum(place + 1, order).astype(np.uint64) << np.uint64(56))
    for back in range(1, order):
        keys[back:] |= np.where(place[back:] >= back, data[:-back] << np.uint64(8 * back), np.uint64(0))
    return keys[place > 0], counts


def keys_of(sequences: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(g) | len(g) << 56 for g in sequences], np.uint64)


def contexts_of(keys: np.ndarray) -> np.ndarray:
    """The keys of the sequences without their last bytes."""
    return ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (((keys >> np.uint64(56)) - np.uint64(1)) << np.uint64(56))


def sequences_of(keys: np.ndarray) -> pa.Array:
    """The sequences of keys, as binary."""
    sizes = (keys >> np.uint64(56)).astype(np.int64)
    held = np.arange(8) >= 8 - sizes[:, None]
    data = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[held]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Values:
    """Values of sequences by key, in flat arrays, which many keys are looked up in at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(slots[order], np.arange((1 << int(64 - int(self.shift))) + 1)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not held."""
        slots = self._slots(keys)
        at, end = self.first[slots], self.first[slots + 1]
        found = np.full(len(keys), -1)
        rest = np.flatnonzero(at < end)
        while len(rest):
            here = at[rest]
            same = self.keys[here] == keys[rest]
            found[rest[same]] = here[same]
            rest, here = rest[~same], here[~same] + 1
            at[rest] = here
            rest = rest[here < end[rest]]
        return found


@dataclass
class Scorer:
    """What workers need of a model."""

    evidence: Values
    contexts: Values

    def words(self, words: list[bytes]) -> np.ndarray:
        """The evidence of each word, none of them empty."""
        if len(words) > WORDS_AT_ONCE:
            return np.concatenate([self.words(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
        keys, counts = sequence_keys(words)
        if not len(keys):
            return np.zeros(0)
        at = self.evidence.find(keys)
        values, known = np.zeros(len(keys), np.longdouble), at >= 0
        values[known] = self.evidence.values[at[known]]
        other = np.flatnonzero(~known)
        at = self.contexts.find(contexts_of(keys[other]))
        values[other[at >= 0]] = self.contexts.values[at[at >= 0]]
        return np.maximum(0.0, np.add.reduceat(values, np.cumsum(counts) - counts).astype(np.float64) - DEAD)

    def texts(self, texts: list[str]) -> list[float]:
        """The length-normalised evidence of each text; distinct words are valued once, and few have any."""
        split = [tokens(x) for x in texts]
        distinct = list(set().union(*split))
        values = self.words(distinct)
        said = {distinct[i]: float(values[i]) for i in np.flatnonzero(values)}
        return [math.fsum(map(said.__getitem__, filter(said.__contains__, found))) / (len(found) + PRIOR_WORDS) for found in split]


@dataclass
class Curve:
    slope: float = 1.0
    middle: float = 0.1
    fallback: float | None = None


@dataclass
class Model:
    """evidence: of sequences that a class has seen; contexts: of any other sequence after that context."""

    evidence: dict[bytes, float]
    contexts: dict[bytes, float]
    curve: Curve = field(default_factory=Curve)

    def scorer(self) -> Scorer:
        return Scorer(*(Values(keys_of(list(x)), np.array(list(x.values()), np.float64)) for x in (self.evidence, self.contexts)))


@dataclass
class Tables:
    """The model as tables evidence (gram, value) and contexts (gram, value), for any number of sequences."""

    evidence: DataFrame
    contexts: DataFrame
    curve: Curve = field(default_factory=Curve)

    def scorer(self) -> Scorer | None:
        """None if there are more sequences than may be broadcast."""
        parts = (self.evidence, self.contexts)
        if max(x.count() for x in parts) > BROADCAST_ROWS:
            return None
        tables = [x.select("gram", "value").toArrow() for x in parts]
        return Scorer(*(Values(keys_of(t.column("gram").to_pylist()), t.column("value").to_numpy()) for t in tables))


def estimate(table: list[tuple[bytes, int, int]], order: int = ORDER, d: float = DISCOUNT) -> Model:
    """A model from (sequence, count in ordinary, count in toxic) of the highest order."""
    suffixes = {g[i:] for g, _, _ in table for i in range(1, len(g))}
    kinds: Counter[bytes] = Counter()  # continuation counts: distinct bytes before each shorter sequence
    seen = suffixes.union(g for g, _, _ in table)
    for g in seen:
        if len(g) > 1:
            kinds[g[1:]] += 1
    total: Counter[bytes] = Counter()
    types: Counter[bytes] = Counter()
    for g, n in kinds.items():
        total[g[:-1]] += n
        types[g[:-1]] += 1
    shared: dict[bytes, float] = {}

    def backoff(g: bytes) -> float:
        if not g:
            return 1 / 257
        if (p := shared.get(g)) is None:
            h = g[:-1]
            p = backoff(g[1:]) if len(g) > 1 else 1 / 257
            if t := total.get(h):
                p = max(kinds.get(g, 0) - d, 0) / t + d * types[h] / t * p
            shared[g] = p
        return p

    sums = (Counter(), Counter())
    spread = (Counter(), Counter())
    for g, *counts in table:
        for k in (0, 1):
            if counts[k]:
                sums[k][g[:-1]] += counts[k]
                spread[k][g[:-1]] += 1
    evidence, contexts = {}, {}
    for h in sums[0].keys() | sums[1].keys():
        free = [d * spread[k][h] / sums[k][h] if sums[k][h] else 1.0 for k in (0, 1)]
        contexts[h] = math.log(free[1] / free[0])
    for g, *counts in table:
        h, p = g[:-1], backoff(g[1:])
        q = [max(counts[k] - d, 0) / sums[k][h] + d * spread[k][h] / sums[k][h] * p if sums[k][h] else p for k in (0, 1)]
        evidence[g] = math.log(q[1] / q[0])
    return Model(evidence, contexts)


def estimate_tables(counted: DataFrame, d: float = DISCOUNT) -> Tables:
    """What `estimate` makes, from the same counts as a table (gram, n0, n1)."""
    size, before = F.octet_length("gram"), lambda g: F.substring(g, F.lit(1), F.octet_length(g) - 1)
    after = lambda g: F.substring(g, F.lit(2), F.octet_length(g))
    suffixes = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("gram"), i, F.octet_length("gram")))
    seen = counted.select(F.explode(suffixes).alias("gram")).distinct()
    kinds = seen.filter(size > 1).groupBy(after(F.col("gram")).alias("gram")).agg(F.count(F.lit(1)).alias("kinds")).withColumn("before", before(F.col("gram")))
    kinds = cut(kinds)
    totals = kinds.groupBy("before").agg(F.sum("kinds").alias("total"), F.count(F.lit(1)).alias("types"))
    # each length leans on the one below it
    parts = kinds.join(totals, "before").select("gram", (F.greatest(F.col("kinds") - d, F.lit(0.0)) / F.col("total")).alias("own"), (d * F.col("types") / F.col("total")).alias("free"))
    parts = cut(parts)
    longest = parts.agg(F.max(size)).first()[0] or 0
    shared = below = parts.filter(size == 1).select("gram", (F.col("own") + F.col("free") / 257).alias("p"))
    for n in range(2, longest + 1):
        below = cut(parts.filter(size == n).withColumn("_after", after(F.col("gram"))).join(below.select(F.col("gram").alias("_after"), "p"), "_after").select("gram", (F.col("own") + F.col("free") * F.col("p")).alias("p")))
        shared = shared.unionByName(below)
    split = counted.withColumn("before", before(F.col("gram")))
    sums = split.groupBy("before").agg(*(f(k) for k in (0, 1) for f in (lambda k: F.sum(f"n{k}").alias(f"sum{k}"), lambda k: F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"spread{k}"))))
    for k in (0, 1):
        sums = sums.withColumn(f"free{k}", F.when(F.col(f"sum{k}") > 0, d * F.col(f"spread{k}") / F.col(f"sum{k}")).otherwise(1.0))
    contexts = sums.select(F.col("before").alias("gram"), F.ln(F.col("free1") / F.col("free0")).alias("value"))
    q = [F.when(F.col(f"sum{k}") > 0, F.greatest(F.col(f"n{k}") - d, F.lit(0.0)) / F.col(f"sum{k}") + F.col(f"free{k}") * F.col("p")).otherwise(F.col("p")) for k in (0, 1)]
    rows = split.join(sums, "before").withColumn("_after", after(F.col("gram"))).join(shared.select(F.col("gram").alias("_after"), "p"), "_after")
    return Tables(cut(rows.select("gram", F.ln(q[1] / q[0]).alias("value"))), cut(contexts))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, classes weighed alike, with a weak ridge; Newton's method."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones(len(x))])
    weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    b = np.array([1.0, 0.0])
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(b @ z, -40, 40)))
        gradient = z @ (weigh * (p - y)) + ridge @ b
        hessian = (z * (weigh * p * (1 - p))) @ z.T + ridge
        step = np.linalg.solve(hessian, gradient)
        b = b - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    slope = max(b[0], 1e-3)
    return slope / scale, float(-b[1] / slope * scale)


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n0, n1): counts of byte sequences by class. Words are counted first, over a task's rows up to MOST_HELD distinct ones."""

    def counted_grams(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        held = list(counts[0].keys() | counts[1].keys())
        keys, of = sequence_keys(held, order)
        unique, place = np.unique(keys, return_inverse=True)
        sums = [np.zeros(len(unique), np.int64) for _ in counts]
        for n, c in zip(sums, counts):
            np.add.at(n, place, np.repeat(np.fromiter(map(c.__getitem__, held), np.int64, len(held)), of))
        return pa.RecordBatch.from_arrays([sequences_of(unique), *map(pa.array, sums)], ["gram", "n0", "n1"])

    def run(batches):
        counts = (Counter(), Counter())
        for batch in sliced(batches):
            for text, toxic in zip(text_list(batch), batch.column("toxic").to_pylist()):
                counts[toxic].update(tokens(text))
            if len(counts[0]) + len(counts[1]) > MOST_HELD:
                yield counted_grams(counts)
                counts = (Counter(), Counter())
        yield counted_grams(counts)

    counted = map_arrow(rows.select("text", "toxic"), run, "gram binary, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _exact(value):
    """Sums of these don't depend on the order of rows."""
    return value.cast("decimal(28,18)")


def word_evidence(words: DataFrame, model: Tables) -> DataFrame:
    """(word, value) of those distinct words (word) whose evidence counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(w, g, g[:-1]) for w in batch.column("word").to_pylist() for g in grams(w)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (list(zip(*pairs)) or [[]] * 3)], ["word", "gram", "before"])

    parts = map_batches(words.select("word"), run, "word binary, gram binary, before binary")
    found = parts.join(model.evidence, "gram", "left").join(model.contexts.select(F.col("gram").alias("before"), F.col("value").alias("context")), "before", "left")
    value = F.sum(_exact(F.coalesce("value", "context", F.lit(0.0)))).cast("double") - DEAD
    return found.groupBy("word").agg(value.alias("value")).filter("value > 0")


def joined_evidence(docs: DataFrame, model: Tables) -> DataFrame:
    """All columns and `_evidence`, by joins; texts are known by their digest, as equal ones have equal evidence."""

    def run(batches):
        for batch in sliced(batches):
            rows = [(key, w, n) for key, text in zip(batch.column("_text").to_pylist(), text_list(batch)) for w, n in Counter(tokens(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.binary(), pa.int64()))], ["_text", "word", "n"])

    keyed = docs.withColumn("_text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    held = map_arrow(keyed.select("_text", "text"), run, "_text string, word binary, n long")
    values = cut(word_evidence(held.select("word").distinct(), model))
    # copies of a text give the same rows, once each after the distinct
    sums = held.join(small(values), "word").distinct().groupBy("_text").agg(F.sum(_exact(F.col("value")) * F.col("n").cast("decimal(9,0)")).cast("double").alias("_sum"))
    evidence = F.coalesce("_sum", F.lit(0.0)) / (n_words(F.col("text")) + PRIOR_WORDS)
    return keyed.join(sums, "_text", "left").select(*(F.col(f"`{c}`") for c in docs.columns), evidence.alias("_evidence"))


def with_evidence(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """All columns and `_evidence`."""
    scorer = model.scorer()
    if scorer is None:
        return joined_evidence(docs, model)
    handed = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("_evidence", pa.array(handed.value.texts(text_list(batch)), pa.float64()))

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("_evidence", T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, most_grams: int = MOST_GRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Model | Tables:
    """Learns from labelled rows outside fold 0."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    marks = small(marks.filter(fold(F.col("_id")) != 0))
    rows = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    counted = gram_counts(rows.filter(fold(F.col("doc_id")) != CALIBRATION_FOLD)).persist()
    n, *sums = counted.agg(F.count(F.lit(1)), F.sum("n0"), F.sum("n1")).first()
    if not all(sums):
        counted.unpersist()
        return Model({}, {}, Curve(fallback=0.25))
    model = estimate([(bytes(g), a, b) for g, a, b in counted.collect()]) if n <= most_grams else estimate_tables(counted)
    counted.unpersist()
    fitted = rows.filter(fold(F.col("doc_id")) == CALIBRATION_FOLD)
    chosen = fitted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    fitted = fitted.join(small(chosen, calibration_rows), "doc_id", "left_semi")
    pairs = with_evidence(fitted.select("text", "toxic"), model).select("_evidence", "toxic").collect()
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    if len(pairs) and 0 < y.sum() < len(y):
        model.curve.slope, model.curve.middle = fit_curve(x, y)
    return model


def score(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """All columns, and `_evidence` and `_score`. No shuffle while the model is broadcast."""
    found, curve = with_evidence(docs, model), model.curve
    if curve.fallback is not None:
        return found.withColumn("_score", F.lit(curve.fallback))
    at = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), curve.slope * (F.col("_evidence") - curve.middle)))
    return found.withColumn("_score", 1 / (1 + F.exp(-at)))


def toxicity(docs: DataFrame, labels: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row."""
    found = score(docs.select("doc_id", "text"), train(docs, labels, most_grams))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score under 0.5, all columns kept."""
    return score(docs, train(docs, labels)).filter("_score < 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))
