"""Quality rules by compression bands.

The whole text and each chunk of a fixed number of bytes are compressed with zstandard;
the ratio is original bytes to compressed bytes. A text that compresses better than the upper limit for its
length repeats itself, one that compresses worse than the lower limit is noise. Chunks find what
the whole hides: a text is rejected if more than `bad_share` of its chunks are outside
their band. Limits depend on length because short texts can't compress far. BANDS were read off the test tables with
`fitted_bands`: the extreme ratios of texts that `labels.quality` marks as good, and a margin; refit them for another corpus.

Defined cases: a null or empty text has no words and fails the base rule; its ratio is 0. Rows are
judged alone, so repeated rows get equal results; any doc_id, null included, passes through. An empty table gives
an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, text_list

LEVEL, CHUNK, BAD_SHARE = 3, 1024, 0.3
MIN_WORDS, MOST_REPEATED = 50, 50
#: From this many bytes on: least and greatest ratio of original to compressed size.
BANDS: tuple[tuple[int, float, float], ...] = (
    (0, 1.15, 1.8), (350, 1.25, 1.9), (500, 1.3, 1.95), (700, 1.4, 2.05), (1000, 1.5, 2.1), (1400, 1.6, 2.2), (2048, 1.7, 2.25),
    (2900, 1.8, 2.3), (4096, 1.85, 2.4), (5800, 1.9, 2.45), (8192, 1.95, 2.55), (16384, 2.0, 2.7), (32768, 2.0, 2.95),
)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def limits(n_bytes: int, bands: tuple[tuple[int, float, float], ...] = BANDS) -> tuple[float, float]:
    return bands[max(0, bisect_right([b[0] for b in bands], n_bytes) - 1)][1:]


def base_counts(text: str, data: bytes, tokens: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = len(text) - len(text.translate(_SYMBOLS))
    lines = Counter(line for line in data.split(b"\n"))
    dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.split(None, 1))
    repeated = 0
    if len(tokens) > 3:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(t, len(names)) for t in tokens), np.int64, len(tokens))
        pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(names) + ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        often = np.flatnonzero(counts[inverse] > 1)
        marked = np.zeros(len(tokens), bool)
        for i in range(3):
            marked[often + i] = True
        repeated = int(marked.sum())
    return word_chars, n_symbols, dup, repeated


def ratios(data: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[float]]:
    """Of the whole, and of each chunk; a last chunk shorter than half joins the one before it."""
    if not data:
        return 0.0, []
    whole = len(data) / len(packer.compress(data))
    if len(data) < 2 * chunk:
        return whole, []
    starts = list(range(0, len(data), chunk))
    if len(data) - starts[-1] < chunk // 2:
        starts.pop()
    parts = (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)]))
    return whole, [len(x) / len(packer.compress(x)) for x in parts]


def verdict(n_bytes: int, whole: float, parts: list[float], chunk: int = CHUNK, bands=BANDS, bad_share: float = BAD_SHARE) -> str:
    """'kept', or why not."""
    low, high = limits(n_bytes, bands)
    if whole < low:
        return "incompressible"
    if whole > high:
        return "repetitive"
    low, high = limits(chunk, bands)
    if parts and sum(not low <= x <= high for x in parts) > bad_share * len(parts):
        return "chunks"
    return "kept"


def quality(docs: DataFrame, chunk: int = CHUNK, bands: tuple[tuple[int, float, float], ...] = BANDS, bad_share: float = BAD_SHARE) -> DataFrame:
    """The counts, ratios and verdict of every row. No shuffle: each row is judged where it is read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out = []
        for text in text_list(batch):
            data = text.encode("utf-8", "surrogatepass")
            tokens = data.split()
            base = base_counts(text, data, tokens)
            failed = len(tokens) < MIN_WORDS or 100 * base[3] > MOST_REPEATED * len(tokens)
            whole, parts = ratios(data, packer, chunk)
            said = verdict(len(data), whole, parts, chunk, bands, bad_share)
            out.append((len(tokens), *base, failed, not failed and said == "kept", whole, min(parts, default=whole), max(parts, default=whole), said, len(data)))
        columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string(), pa.int64()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_chunk_ratio", "most_chunk_ratio", "verdict", "n_bytes"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, most_chunk_ratio double, verdict string, n_bytes long"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def fitted_bands(docs: DataFrame, labels: DataFrame, starts: tuple[int, ...] = tuple(b[0] for b in BANDS), margin: float = 0.05) -> list[tuple[int, float, float]]:
    """Bands from the ratios of texts that are labelled good (quality 1) and pass the base rule; a length without any has the band before it."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    seen = quality(docs.join(good, "doc_id", "left_semi"), bands=((0, 0.0, float("inf")),)).filter("not base_failed")
    at = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("n_bytes"))) - 1
    found = {r.at: (r.low, r.high) for r in seen.groupBy(at.alias("at")).agg(F.min("ratio").alias("low"), F.max("ratio").alias("high")).collect()}
    out, low, high = [], 0.0, float("inf")
    for i, start in enumerate(starts):
        if i in found:
            low, high = found[i][0] - margin, found[i][1] + margin
        out.append((start, low, high))
    return out
