"""PII: base patterns, and information-theoretic sanitisation of terms that give entities away.

The entities to protect are the addresses and numbers that the base patterns find. A term
reveals an entity as far as their pointwise mutual information reaches the entity's own information
content, both estimated over the whole corpus: PMI = log2(n(t,e) * N / (n(t) * n(e))) against IC = log2(N / n(e)).
All four count distinct documents: rows with the same words, case aside, are one, so copies neither make evidence nor hide it,
while form letters that differ anywhere count one by one. A term seen near an entity (within AROUND words) in at least `support` distinct documents is
generalised (to a class of term) from `generalise` on and removed from `remove` on, in every document that holds the entity. A pair seen
in fewer documents is weak evidence: its term is generalised, and only from `remove` on, as is a name that the whole corpus has but beside one address.

Defined cases: a null text is empty. Spans of one kind don't overlap; spans of different kinds
may, and sanitising replaces their union. Repeated rows count as one document, and get equal
results, whatever their ids; an id may be null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import cut, map_arrow, map_batches, sliced, small, text_list, words

KINDS = ("email", "ip", "card", "phone")
AROUND, SUPPORT, GENERALISE, REMOVE = 12, 3, 0.6, 0.85
#: Distinct terms that a task counts before it passes them on.
MOST_HELD = 150_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of digits never ends within a run of digits, so only the start of a run can begin one: that keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'"


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, which finds the leftmost matches in linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """The identity of what a span names, whatever its punctuation."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:" + "".join(c for c in value if c.isdigit())


def term(word: str) -> str:
    return word.strip(_EDGE).lower()


def folded_words(text: Column) -> Column:
    return words(F.lower(text))


def cluster_of(folded: Column) -> Column:
    """Documents with the same words, case aside, are one."""
    return F.xxhash64(F.array_join(folded, " "))


def might_hold(text: Column) -> Column:
    """Whether a text can hold a base span at all; native, so that most texts are passed over without Python. One class of characters is looked for before any alternative."""
    return F.coalesce(F.rlike(text, F.lit(r"(?=[@+0-9])(?:@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){13})")), F.lit(False))


def _free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether outside all spans) of each word, in time linear in words and spans; spans are by start."""
    out, i, ends = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][1] < m.end():
            ends = max(ends, spans[i][2])
            i += 1
        out.append((m.start(), m.end(), ends <= m.start()))
    return out


def contexts(docs: DataFrame) -> DataFrame:
    """(copy, entity, term) of the AROUND words on either side of each entity; copy tells distinct documents apart. An entity without words has one row without a term."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for copy, text in zip(batch.column("copy").to_pylist(), text_list(batch)):
            if not (spans := base_spans(text)):
                continue
            found = _free_words(text, spans)
            starts, ends = [w[0] for w in found], [w[1] for w in found]
            for kind, a, b in spans:
                before, after = bisect_right(ends, a), bisect_left(starts, b)
                near = [*found[max(0, before - AROUND) : before], *found[after : after + AROUND]]
                named = {t for x, y, free in near if free and len(t := term(text[x:y])) > 2}
                rows.update((copy, entity(kind, text[a:b]), t) for t in named or [None])
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["copy", "entity", "term"])

    held = docs.filter(might_hold(F.col("text"))).select(cluster_of(folded_words(F.col("text"))).alias("copy"), "text")
    return map_batches(held, run, "copy long, entity string, term string")


def _parted(docs: DataFrame) -> DataFrame:
    """(copy, hashes) of each row: its document and the distinct terms in it, as hashes, which are cheaper to tell apart and to carry than strings."""
    parts = docs.select(folded_words(F.col("text")).alias("folded"))
    return parts.select(cluster_of(F.col("folded")).alias("copy"), F.array_distinct(F.transform("folded", lambda w: F.xxhash64(F.btrim(w, F.lit(_EDGE))))).alias("hashes"))


def counted(docs: DataFrame) -> DataFrame:
    """(hash, copied, n), in parts to be summed: rows of each document (copied, hash as `cluster_of` has it) and rows that hold a term (not copied, hash as `_parted` has it).

    Texts are read once for both; a task counts terms itself, up to MOST_HELD distinct ones.
    """

    def summed(terms: Counter[bytes], rows: Counter[int]) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms)).view(np.int64)
        columns = [np.concatenate([hashes, np.array(list(rows), np.uint64).view(np.int64)]), np.arange(len(terms) + len(rows)) >= len(terms), np.array([*terms.values(), *rows.values()], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "copied", "n"])

    def run(batches):
        edge = _EDGE.encode()
        terms: Counter[bytes] = Counter()
        rows: Counter[int] = Counter()
        for batch in sliced(batches):
            for text in batch.column("folded").to_pylist():
                found = text.split()
                rows[xxhash.xxh64_intdigest(b" ".join(found), 42)] += 1
                terms.update({w.strip(edge) for w in set(found)})
            if len(terms) > MOST_HELD:
                yield summed(terms, rows)
                terms, rows = Counter(), Counter()
        yield summed(terms, rows)

    return map_arrow(docs.select(F.coalesce(F.lower("text"), F.lit("")).cast("binary").alias("folded")), run, "hash long, copied boolean, n long")


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, rare: float = REMOVE) -> DataFrame:
    """(entity, term, n_both, disclosure): terms at or over their threshold."""
    joint = cut(found.filter("term is not null").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")))
    held = found.select("entity", "copy").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # document frequency over the whole corpus, of the terms in question
    wanted = joint.select(F.xxhash64("term").alias("hash"), F.lit(False).alias("copied")).distinct()
    counts = counted(docs).join(small(wanted).withColumn("_wanted", F.lit(True)), ["hash", "copied"], "left").filter("copied or _wanted")
    counts = cut(counts.groupBy("hash", "copied").agg(F.sum("n").alias("n")))
    copies = counts.filter("copied").select(F.col("hash").alias("copy"), F.col("n").alias("rows"))
    total, n_often = copies.agg(F.count(F.lit(1)), F.count_if(F.col("rows") > 1)).first()
    spread = counts.filter("not copied").select("hash", F.col("n").alias("n_term"))
    if n_often:
        # the rows of one document share its weight
        often = small(copies.filter("rows > 1"))
        repeated = docs.select("text", cluster_of(folded_words(F.col("text"))).alias("_at")).join(often.withColumnRenamed("copy", "_at"), "_at", "left_semi").select("text")
        excess = _parted(repeated).join(often, "copy").select(F.explode("hashes").alias("hash"), (1 - 1 / F.col("rows")).alias("excess")).groupBy("hash").agg(F.sum("excess").alias("excess"))
        spread = spread.join(excess, "hash", "left").select("hash", F.round(F.col("n_term") - F.coalesce("excess", F.lit(0.0))).alias("n_term"))
    n = F.lit(float(max(1, total)))
    both = joint.withColumn("hash", F.xxhash64("term")).join(held, "entity").join(spread, "hash")
    pmi = F.log2(F.col("n_both") * n / (F.greatest("n_term", "n_both") * F.greatest("n_entity", "n_both")))
    content = F.log2(n / F.greatest("n_entity", "n_both"))
    disclosure = F.when(content > 0, pmi / F.greatest(content, F.lit(1e-9))).otherwise(0.0)
    return both.select("entity", "term", "n_both", disclosure.alias("disclosure")).filter(F.col("disclosure") >= F.when(F.col("n_both") >= support, generalise).otherwise(rare))


def terms_by_document(docs: DataFrame, support: int = SUPPORT, remove: float = REMOVE) -> DataFrame:
    """(copy, terms array<struct<term, removed>>): for each distinct document that holds an entity, the terms in it that disclose the entity.

    Terms near the entity are met in `contexts`. Terms farther off in the same text are looked for among pairs seen in `support` documents or more:
    what was seen less often was seen near.
    """
    found = cut(contexts(docs))
    shown = cut(disclosing(docs, found, support))
    named = found.filter("term is not null").join(small(shown), ["entity", "term"]).select("copy", "term", "n_both", "disclosure")
    often = shown.filter(F.col("n_both") >= support)
    if not often.isEmpty():
        terms = small(often.select("term", F.xxhash64("term").alias("hash")).distinct())
        here = _parted(docs.filter(might_hold(F.col("text")))).select("copy", F.explode("hashes").alias("hash")).join(terms, "hash").select("copy", "term").distinct()
        far = here.join(found.select("copy", "entity").distinct(), "copy").join(small(often), ["entity", "term"])
        named = named.unionByName(far.select("copy", "term", "n_both", "disclosure"))
    removed = F.max((F.col("n_both") >= support) & (F.col("disclosure") >= remove))
    return cut(named.groupBy("copy", "term").agg(removed.alias("removed")).groupBy("copy").agg(F.collect_list(F.struct("term", "removed")).alias("_terms")))


def _marked(docs: DataFrame) -> DataFrame:
    """All columns and `_terms`, the disclosing terms that the row holds (null: none)."""
    per_copy = terms_by_document(docs.select("text")).withColumnRenamed("copy", "_copy")
    holds, side = might_hold(F.col("text")), small(per_copy)
    if side is not per_copy:
        return docs.withColumn("_at", F.when(holds, cluster_of(folded_words(F.col("text"))))).join(side, F.col("_at") == F.col("_copy"), "left").drop("_at", "_copy")
    # too large to broadcast: only texts that can hold an entity are shuffled
    met = docs.filter(holds).withColumn("_at", cluster_of(folded_words(F.col("text")))).join(per_copy, F.col("_at") == F.col("_copy"), "left").drop("_at", "_copy")
    return met.unionByName(docs.filter(~holds).withColumn("_terms", F.lit(None).cast(per_copy.schema["_terms"].dataType)))


def all_spans(text: str, terms: dict[str, bool], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans and, outside them, those of disclosing terms (true: removed)."""
    out = list(base)
    if terms:
        for a, b, free in _free_words(text, base):
            if free and (t := term(text[a:b])) in terms:
                out.append(("removed" if terms[t] else "generalised", a, b))
    order = {k: i for i, k in enumerate((*KINDS, "removed", "generalised"))}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def generalised(word: str) -> str:
    t = term(word)
    return "[NUMBER]" if t.isdigit() else "[NAME]" if word.strip(_EDGE)[:1].isupper() else "[TERM]"


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], generalised(text[a:b]) if kind == "generalised" else "" if kind == "removed" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _terms_of(batch: pa.RecordBatch) -> list[dict[str, bool]]:
    return [{x["term"]: x["removed"] for x in row or []} for row in batch.column("_terms").to_pylist()]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, n_terms) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, terms in zip(text_list(batch), _terms_of(batch)):
            base = base_spans(text)
            spans = all_spans(text, terms, base)
            kinds = [k for k, *_ in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
        columns = list(zip(*rows)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms"]
    return map_batches(_marked(docs.select("doc_id", "text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long")


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data replaced in the text (n_chars follows if there is one); other texts stay as they are."""
    schema = T.StructType([f for f in docs.schema.fields])
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lengths = batch.column("text").to_pylist(), batch.column(n_at).to_pylist() if n_at is not None else []
        for i, terms in enumerate(_terms_of(batch)):
            if texts[i] and (spans := all_spans(texts[i], terms, base_spans(texts[i]))):
                texts[i] = sanitise(texts[i], spans)
                if n_at is not None:
                    lengths[i] = len(texts[i])
        columns = [batch.column(i) for i in range(len(docs_columns))]
        columns[at] = pa.array(texts, batch.column(at).type)
        if n_at is not None:
            columns[n_at] = pa.array(lengths, batch.column(n_at).type)
        return pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return map_batches(_marked(docs), run, schema)
