"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import bisect
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from corvane.llm import compression, fingerprints, licenses, mixing, pii, simhash, toolcalls, toxicity, urls
from corvane.llm.graph import components
from corvane.operators import memory

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DICE = random.Random(3)
VOCABULARY = ["".join(DICE.choice("abcdefgéß") for _ in range(DICE.randrange(2, 8))) for _ in range(400)]


def prose(n, seed):
    dice = random.Random(seed)
    return "".join(dice.choice(VOCABULARY) + dice.choice([" ", " ", " ", "\n", ". "]) for _ in range(n))


def documents(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' as lang", "cast(length(text) as long) as n_chars", "1 as size", "2 as fp", "3 as key", "4 as bucket", "5 as block", "6 as sketch", "7 as score")


def hard_rows():
    long = prose(30_000, 9)
    rows = [(1, prose(80, 1), "a"), (2, prose(80, 1), "b"), (3, None, "a"), (4, "", None), (5, "one two", "a"), (5, "one two", "a"), (6, long, "b"), (7, " \n\t ", "b"), (None, prose(60, 2), None), (300, prose(90, 3), "ü")]
    return rows + [(1000 + i, prose(70, 100 + i // 3), "abc"[i % 3]) for i in range(30)]


@pytest.fixture(scope="module")
def hard(spark):
    return documents(spark, hard_rows()).persist()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_sketch(text, k=128):
    words = WORD.findall(text)
    chain = lambda start, values: __import__("functools").reduce(lambda seed, v: xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed), values, start)
    each = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(words) >= 5:
        found = {chain(42, each[i : i + 5]) for i in range(len(words) - 4)}
    else:
        found = {xxhash.xxh64_intdigest(" ".join(words).encode(), xxhash.xxh64_intdigest(b"short", 42))} if words else set()
    return sorted({x & ((1 << 48) - 1) for x in found})[:k]


def plain_likeness(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_fingerprints(spark, hard):
    wide = [(2**63 - 1, prose(90, 41), "a"), (-(2**63), prose(90, 42), "a"), (10**15, prose(60, 43), "a"), (None, prose(40, 44), "a"), (None, "", "a"), *((777, prose(30, 60 + i), "a") for i in range(12))]
    rows = [(i, t or "") for i, t, _ in hard_rows() + wide]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, changed, ahead = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        digits = lambda s: "".join(f"{x:012x}" for x in s)
        want.append((i is None, i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(changed), round(plain_likeness(own, changed), 9), round(plain_likeness(own, ahead), 9)))
    docs = documents(spark, hard_rows() + wide)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)
    # small blocks: heads are handed on from block to block, and no block is large
    follow = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.next_text) for r in fingerprints.with_next(texts, block_rows=4).collect()))
    assert follow == sorted((i is None, i or 0, t, after) for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]))
    assert fingerprints.fingerprints(hard.limit(0)).count() == 0 and fingerprints.fingerprints(hard.limit(1)).first().near_next == 1.0


def test_blocks_are_even_whatever_the_ids(spark):
    """Clustered, repeated and null ids make no large block."""
    ids = "case when id < 700 then id when id < 1400 then 5000000000000000000 + id when id < 2100 then 77 when id < 2800 then null else -9000000000000000000 + id end"
    keyed = spark.range(3000).selectExpr(f"{ids} as doc_id", "concat('text ', id) as text")
    keys = keyed.select(*fingerprints._order("text"))
    sizes = [r["count"] for r in keys.groupBy(fingerprints._block(fingerprints._bounds(keys, 3000, 50, 1000))).count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 200


def test_blocks_are_found_by_halving(spark):
    """The right block for any key, and a row costs about the same whether there are 500 bounds or 50,000."""
    dice = random.Random(3)
    edge = [(False, -(1 << 63), -(1 << 63)), (False, -1, 5), (False, 0, 5), (False, (1 << 63) - 1, 0), (True, 0, -7), (True, 0, 7)]
    rows = edge + [(False, dice.randrange(-(1 << 63), 1 << 63), dice.randrange(-(1 << 63), 1 << 63)) for _ in range(30_000)]
    keys = spark.createDataFrame(rows, "bare boolean, down long, tie long").repartition(4).cache()
    keys.count()

    def took(n):
        bounds = sorted(edge + [(False, dice.randrange(-(1 << 63), 1 << 63), 0) for _ in range(n - len(edge))])
        began = time.perf_counter()
        got = keys.withColumn("at", fingerprints._block(bounds)).collect()
        seconds = time.perf_counter() - began
        assert all(r["at"] == bisect.bisect_right(bounds, (r.bare, r.down, r.tie)) for r in got)
        return seconds

    took(1), took(500)
    assert min(took(50_000) for _ in range(2)) < 3 * min(took(500) for _ in range(2)) + 1
    keys.unpersist()


def test_sketches_merge_and_estimate(spark):
    base = prose(3000, 5).split()
    df = spark.createDataFrame([("x", " ".join(base[:2000])), ("y", " ".join(base[1000:])), ("z", " ".join(base[:2000]))], "g string, text string").withColumn("sketch", fingerprints.sketch(F.col("text")))
    x, y = (df.filter(F.col("g") == g).select(F.col("sketch").alias(g)) for g in "xy")
    r, c = x.crossJoin(y).select(fingerprints.resemblance(F.col("x"), F.col("y")), fingerprints.containment(F.col("x"), F.col("y"))).first()
    assert abs(r - 1 / 3) < 0.13 and abs(c - 0.5) < 0.2
    merged = fingerprints.merge_all(df.withColumn("h", F.lit(1)).drop("h"), ["g"]).collect()
    assert {m.g: m.sketch for m in merged}["x"] == x.first()[0]
    one = fingerprints.merge_all(df.withColumn("all", F.lit(1)).select("all", "sketch"), ["all"]).first().sketch
    assert one == sorted(set(x.first()[0]) | set(y.first()[0]))[:128]


def test_simhash_against_all_pairs(spark, hard):
    rows = hard_rows() + [(2000 + i, prose(300, 77)[: 1500 - 3 * i], "a") for i in range(12)]
    docs = documents(spark, rows)

    def plain(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, plain(t)) for i, t, _ in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    want = sorted((i or -1, f"{p:016x}", min((j for b, (j, _) in enumerate(prints) if root(b) == root(a) and j is not None), default=-1)) for a, (i, p) in enumerate(prints))
    for hot in (simhash.HOT, 2):
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(docs, hot).collect()) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted({c if c > 0 else -1 for *_, c in want})
    assert simhash.near_duplicates(hard.limit(0)).count() == 0


def test_fingerprints_of_texts_of_any_length():
    """Bits are summed in bytes, block by block."""
    for n in (0, 1, 3, 4, 5, 257, 258, 259, 260, 700, 3000):
        for text in (prose(n, n), "same " * n):
            held = [w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), text).split()]
            hashes = [xxhash.xxh64_intdigest(b" ".join(held[i : i + 4]), 42) for i in range(max(1, len(held) - 3))] if held else []
            assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_position_triples_meet_every_choice_of_four():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20 and all(any(set(t) <= set(c) for t in simhash.TRIPLES) for c in combinations(range(8), 4))


def test_components(spark):
    dice = random.Random(1)
    pairs = [(dice.randrange(60), dice.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


def test_mixing(spark, hard):
    got = mixing.mix(hard, range_rows=4).collect()
    rows = hard_rows()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    free, targets, left = set(sources), {}, 1.5 * sum(sums.values())
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sums[s]}
        if not over:
            targets |= {s: weights[s] * level for s in free}
            break
        for s in over:
            targets[s] = 2.0 * sums[s]
            left -= targets[s]
        free -= over
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in targets.values()})
    assert sum(r.taken for r in got) == sum(int(x + 1e-9) for x in targets.values()) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(hard.repartition(7), range_rows=4).collect()))
    mixed = mixing.mixed_documents(hard)
    assert mixed.columns == hard.columns and sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix(hard.limit(0)).count() == 0 and mixing.mixed_documents(hard.limit(0)).count() == 0


def test_quality(spark, hard):
    # one passage again and again with new words between: under half of its words repeat, but it compresses too well
    passage, dice = prose(25, 13).split(), random.Random(5)
    mixed = [w for _ in range(12) for w in [*passage, *("".join(dice.choice("abcdefghi") for _ in range(4)) for _ in range(30))]]
    extra = [(54, " ".join(mixed), "a"), (50, "w%d " * 3 % (1, 2, 3) + "same line here\nsame line here\n same line here\n#$ a<b|c>& %*", "a"), (51, ("Spam and eggs again. " * 200), "a"), (52, "".join(DICE.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9000)), "a"), (53, " ".join("".join(DICE.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP") for _ in range(9)) for _ in range(900)), "a")]
    rows = hard_rows() + extra
    got = {(r.doc_id, r.n_words): r for r in compression.quality(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        from collections import Counter

        often = Counter(windows)
        marked = {j + d for j, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and (not r.kept or not r.base_failed)
        data, squeeze = t.encode(), lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
        band = lambda n: [(a, b) for least, a, b in compression.BANDS if least <= n][-1]
        whole = squeeze(data) if data else 0.0
        cuts = [data[j : j + 1024] for j in range(0, len(data), 1024)] if len(data) >= 2048 else []
        if cuts and len(cuts[-1]) < 512:
            cuts[-2:] = [cuts[-2] + cuts[-1]]
        outside = [x for x in map(squeeze, cuts) if not band(1024)[0] <= x <= band(1024)[1]]
        low, high = band(len(data))
        verdict = "incompressible" if whole < low else "repetitive" if whole > high else "chunks" if len(outside) > 0.3 * len(cuts) else "kept"
        assert (r.verdict, r.kept, r.n_bytes) == (verdict, verdict == "kept" and not r.base_failed, len(data)) and abs(r.ratio - whole) < 1e-9
    assert got[51, 800].base_failed and got[53, 900].verdict == "incompressible" and not got[53, 900].kept
    assert len({r.verdict for r in got.values()}) > 2 and any(r.verdict == "repetitive" and not r.base_failed for r in got.values())
    assert compression.quality(hard.limit(0)).count() == 0


def test_bands_follow_good_texts(spark):
    rows = [(i, prose(60 + 20 * (i % 20), 3000 + i), "a") for i in range(60)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    bands = compression.fitted_bands(documents(spark, rows), lab, starts=(0, 700, 1400, 10**6), margin=0.0)
    packer = zstandard.ZstdCompressor(level=3)
    for i, t, _ in rows:
        data = t.encode()
        low, high = compression.limits(len(data), tuple(bands))
        assert i % 3 == 0 or low <= len(data) / len(packer.compress(data)) <= high
    assert bands[3][1:] == bands[2][1:] and bands[0][1:] != bands[1][1:]


def test_toxicity(spark):
    dice = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(120, 500 + i).split()
        if toxic:
            for _ in range(8):
                words.insert(dice.randrange(len(words)), dice.choice(["zorkling", "zorkles", "quaxhead", "quaxed"]) + dice.choice(["", "ix", "um"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "x", "a"), (0, rows[0][1], "a")]
    docs = documents(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1), (77777, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("zorkling"))
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)
    lab2 = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, lab2).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    assert {r.score for r in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0.25}
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_toxicity_keeps_every_sequence(spark):
    """A model too large to broadcast is joined: no sequence goes, and scores stay what they are."""
    rows = [(i, prose(30, i) + (" zorkling quaxhead" if i % 4 == 0 else ""), "a") for i in range(200)]
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "zorkling é", "a"), (0, rows[0][1], "a"), (0, rows[0][1], "a"), (9002, "x" * 200 + " quaxhead quaxhead", "a")]
    docs = documents(spark, rows)
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    whole, joined = toxicity.train(docs, lab), toxicity.train(docs, lab, most_grams=0)
    for part in ("evidence", "contexts"):
        got = {bytes(r.gram): r.value for r in getattr(joined, part).collect()}
        want = getattr(whole, part)
        assert got.keys() == want.keys() and len(got) > 300 and all(abs(got[g] - want[g]) < 1e-9 for g in got)
    found = [sorted((r.doc_id or -1, round(r._score, 7), round(r._evidence, 9)) for r in toxicity.score(docs, m).collect()) for m in (whole, joined)]
    assert found[0] == found[1] and len(found[0]) == len(rows) and any(e for *_, e in found[0])
    assert toxicity.score(docs, joined).columns[:-2] == docs.columns


def test_a_larger_model_is_still_broadcast(spark, monkeypatch):
    """A model made by aggregation is joined to the words of all texts only if it can't be broadcast; all three forms score alike."""
    rows = [(i, prose(30, i) + (" zorkling quaxhead" if i % 4 == 0 else ""), "a") for i in range(200)] + [(9000, None, "a"), (9001, "é" * 150 + " zorkling", "a")]
    docs, lab = documents(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    scores = lambda model: [(r.doc_id, round(r._score, 7), round(r._evidence, 9)) for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    whole, joined = toxicity.train(docs, lab), toxicity.joined_evidence

    def refused(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(toxicity, "joined_evidence", refused)
    found = scores(toxicity.train(docs, lab, most_grams=0))
    assert found == scores(whole) and any(e for *_, e in found)
    monkeypatch.setattr(toxicity, "joined_evidence", joined)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    assert scores(toxicity.train(docs, lab, most_grams=0)) == found


def test_texts_are_read_a_few_rows_at_once(spark, tmp_path):
    """A task keeps the batch of its reader, with whole texts; all rows pass, in batches of 256 at most."""
    spark.range(5_000).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1).write.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    before = spark.conf.get(key := "spark.sql.parquet.columnarReaderBatchSize")
    for given, n in (("4096", 20), ("100", 50)):
        spark.conf.set(key, given)
        kept = toxicity.without_toxic(spark.read.parquet(f"{tmp_path}/docs"), labels)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(5_000))
        nodes = [kept._jdf.queryExecution().executedPlan()]
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert [x.metrics().apply("numInputBatches").value() for x in nodes if x.nodeName() == "ColumnarToRow"] == [n]
    spark.conf.set(key, before)


def test_words_are_valued_all_at_once():
    rng = random.Random(5)
    held = [bytes(rng.choice(b"\x00\x01\x02ab\xff") for _ in range(rng.choice((1, 2, 3, 9, 63, 64, 65, 200)))) for _ in range(400)]
    keys, counts = toxicity.sequence_keys(held)
    plain = [g for w in held for g in toxicity.grams(w)]
    assert toxicity.sequences_of(keys).to_pylist() == plain and keys.tolist() == toxicity.keys_of(plain).tolist() and counts.tolist() == [len(toxicity.grams(w)) for w in held]
    assert toxicity.contexts_of(keys).tolist() == toxicity.keys_of([g[:-1] for g in plain]).tolist()
    assert [len(x) for x in toxicity.sequence_keys([])] == [0, 0] and [len(x) for x in toxicity.sequence_keys([b""])] == [0, 1]
    table = {g: (rng.randint(0, 3), rng.randint(0, 9)) for g in plain[::2]}
    model = toxicity.estimate([(g, a, b) for g, (a, b) in table.items() if a + b])
    want = [max(0.0, sum(model.evidence.get(g, model.contexts.get(g[:-1], 0.0)) for g in toxicity.grams(w)) - 2.5) for w in held]
    got = model.scorer().words(held)
    assert np.allclose(got, want, rtol=0, atol=1e-12) and any(want) and not all(want)
    assert toxicity.Model({}, {}).scorer().words(held).tolist() == [0.0] * len(held)


def plain_model(table, d=0.75):
    """P(k, g): probability of the last byte of g after the others in class k (None: the shared backoff), by the definition."""
    parts = {g[i:] for g, *_ in table for i in range(len(g))}
    kinds = {}
    for g in parts:
        if len(g) > 1:
            kinds[g[1:]] = kinds.get(g[1:], 0) + 1

    def mixed(counts, g, below):
        after = {x: n for x, n in counts.items() if x[:-1] == g[:-1] and n}
        total = sum(after.values())
        return max(counts.get(g, 0) - d, 0) / total + d * len(after) / total * below if total else below

    def shared(g):
        return mixed(kinds, g, shared(g[1:]) if len(g) > 1 else 1 / 257) if g else 1 / 257

    return lambda k, g: shared(g) if k is None else mixed({x: c[k] for x, *c in table}, g, shared(g[1:]))


TABLE = [(b"\x01a", 3, 1), (b"\x01ab", 2, 1), (b"\x01abc", 2, 0), (b"\x01abd", 0, 2), (b"abcd", 1, 0), (b"bcdb", 1, 4)]


def test_model_probabilities_sum_to_one():
    """Class counts and shared backoff together are a distribution over the next of 257 symbols, and the model holds its log ratios."""
    prob = plain_model(TABLE)
    for k in (None, 0, 1):
        for h in (b"", b"\x01", b"\x01a", b"\x01ab", b"abc", b"bcd", b"zz"):
            if k is not None and not h:
                continue
            own = [prob(k, h + bytes([b])) for b in range(256)]
            assert abs(sum(own) + min(own) - 1) < 1e-9  # the 257th symbol is as likely as any that was never seen
    model = toxicity.estimate(TABLE)
    assert set(model.evidence) == {g for g, *_ in TABLE}
    assert all(abs(model.evidence[g] - math.log(prob(1, g) / prob(0, g))) < 1e-9 for g in model.evidence)
    assert all(abs(model.contexts.get(h, 0.0) - math.log(prob(1, h + b"z") / prob(0, h + b"z"))) < 1e-9 for h in (b"\x01", b"\x01a", b"\x01ab", b"abc", b"bcd", b"zz"))


def test_toxicity_against_the_definition(spark):
    """Counts, ratios, evidence and score of every row, from the labels on, by a plain version."""
    rows, lab = [], []
    for i in range(150):
        rows.append((i, prose(25, 4000 + i) + (" zorkling quaxhead" if i % 5 == 0 else ""), "a"))
        lab.append((i, int(i % 5 == 0)))
    rows += [(900, None, "a"), (901, "zorkling", "a"), (902, "x" * 150, "a")]
    docs, labels = documents(spark, rows), spark.createDataFrame(lab, "doc_id long, toxic int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    text, counts = {i: t or "" for i, t, _ in rows}, {}

    def pieces(word):
        for at in range(0, len(word), 64):
            w = b"\x01" + word[at : at + 64] + b"\x02"
            yield from (w[max(0, i - 4) : i + 1] for i in range(1, len(w)))

    for i, toxic in lab:
        if fold(i) in (1, 2, 3):
            for w in text[i].lower().encode().split():
                for g in pieces(w):
                    counts.setdefault(g, [0, 0])[toxic] += 1
    model = toxicity.estimate([(g, *c) for g, c in counts.items()])  # held to the definition above

    def evidence(t):
        words = t.lower().encode().split()
        ratio = lambda w: sum(model.evidence.get(g, model.contexts.get(g[:-1], 0.0)) for g in pieces(w))
        return sum(max(0.0, ratio(w) - 2.5) for w in words) / (len(words) + 30)

    x, y = zip(*((evidence(text[i]), toxic) for i, toxic in lab if fold(i) == 4))
    slope, middle = toxicity.fit_curve(np.array(x), np.array(y))
    for r in toxicity.toxicity(docs, labels).collect():
        e = evidence(text[r.doc_id])
        assert abs(r.evidence - e) < 1e-9 and abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, slope * (e - middle)))))) < 1e-6
    # the curve has no lower loss nearby
    def loss(s, m):
        z = np.clip(s * (np.array(x) - m), -40, 40)
        p, t = 1 / (1 + np.exp(-z)), np.array(y)
        return -(np.log(p)[t == 1].mean() + np.log(1 - p)[t == 0].mean()) / 2 + 0.5e-4 * (s * np.std(x)) ** 2

    assert all(loss(slope, middle) <= loss(slope * (1 + a), middle * (1 + b)) + 1e-7 for a in (-0.1, 0, 0.1) for b in (-0.1, 0, 0.1))


PII_TEXTS = [
    "mail a.b+c@mail.example.com, or x@y (no), _d@e.f@g.hi end@host.de.",
    "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 010.1.1.1",
    "card 4111 1111 1111 1111 and 4111111111111112 and 5500-0000-0000-0004 x",
    "call +49 (30) 1234-5678 or +1 23 or +1234567890123456 now",
    "é ü 4111111111111111@x.yz +4915112345678",
]


def test_personal_data(spark, hard):
    def plain(t):
        out = []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, t):
                d = re.sub(r"\D", "", m[0])
                ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 10 <= len(d) <= 15
                if ok:
                    out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    dice = random.Random(4)
    noise = ["".join(dice.choice("a1.@+- 9_é(") for _ in range(60)) for _ in range(300)]
    for t in PII_TEXTS + noise:
        assert pii.base_spans(t) == plain(t), t
    rows = [(20_000 + i, t, "a") for i, t in enumerate(PII_TEXTS)] + hard_rows()
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert got[20_000].n_email == len([s for s in plain(PII_TEXTS[0]) if s[0] == "email"])
    assert got[20_002].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(PII_TEXTS[2])).encode()).hexdigest()
    assert pii.personal_data(hard.limit(0)).count() == 0


def plain_disclosure(rows):
    """{(entity, term): (n_both, disclosure)} over all pairs, and the spans of each text."""
    folded = {" ".join(WORD.findall(t or "")).lower(): t or "" for _, t, _ in rows}
    strip = lambda w: w.strip(pii._EDGE).lower()
    holds, near, has = {}, {}, {}
    for doc, text in folded.items():
        spans = pii.base_spans(text)
        tokens = [(m.start(), m.end()) for m in WORD.finditer(text)]
        free = lambda x, y: not any(a < y and x < b for _, a, b in spans)
        for w in {strip(text[x:y]) for x, y in tokens}:
            has.setdefault(w, set()).add(doc)
        for kind, a, b in spans:
            e = pii.entity(kind, text[a:b])
            holds.setdefault(e, set()).add(doc)
            for x, y in [t for t in tokens if t[1] <= a][-12:] + [t for t in tokens if t[0] >= b][:12]:
                if free(x, y) and len(strip(text[x:y])) > 2:
                    near.setdefault((e, strip(text[x:y])), set()).add(doc)
    n, out = len(folded), {}
    for (e, t), docs in near.items():
        content = math.log2(n / len(holds[e]))
        out[e, t] = len(docs), math.log2(len(docs) * n / (len(has[t]) * len(holds[e]))) / content if content > 0 else 0.0

    def spans_of(text):
        base = pii.base_spans(text)
        held = {pii.entity(k, text[a:b]) for k, a, b in base}
        doc = " ".join(WORD.findall(text)).lower()
        terms = {}
        for (e, t), (both, d) in out.items():
            if e in held and d >= (0.6 if both >= 3 else 0.85) and (both >= 3 or doc in near[e, t]):
                terms[t] = terms.get(t, False) or (both >= 3 and d >= 0.85)
        extra = [("removed" if terms[t] else "generalised", m.start(), m.end()) for m in WORD.finditer(text) if (t := strip(m[0])) in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        order = [*pii.KINDS, "removed", "generalised"]
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base + extra, key=lambda s: (s[1], order.index(s[0]))))

    return out, spans_of


def letters():
    rows = [(i, f"{prose(20, 900 + i)} agent{i} Nightjar of {VOCABULARY[i]} wrote to jay@example.com today {prose(10, 950 + i)}", "a") for i in range(6)]
    rows += [(100 + i, prose(40, 700 + i) + f" wrote of {VOCABULARY[i]} today", "a") for i in range(60)]
    rows += [(300 + i, "same words around kim@example.com every time", "a") for i in range(8)]
    # a name met once beside its address; the name of the letters far from the address; ids that are null; entities side by side
    rows += [(400, f"{prose(15, 31)} please write to Zebulon Quartermaine at zq@example.com about it {prose(15, 32)}", "a"), (401, f"Nightjar {prose(50, 33)} jay@example.com", "a"), (None, f"{prose(9, 34)} Nightjar jay@example.com", "a")]
    return rows + [(402, "a@b.org,c@d.org e@f.org 10.0.0.1 +49 (30) 1234-5678 " * 40, "a"), (403, None, "a"), (404, "", "a"), (405, "jay@example.com", "a"), (406, prose(3000, 35) + " 10.0.0.1", "a")]


def test_disclosing_terms(spark):
    rows = letters()
    docs = documents(spark, rows)
    want, spans_of = plain_disclosure(rows)
    shown = {(r.entity, r.term): (r.n_both, round(r.disclosure, 9)) for r in pii.disclosing(docs, pii.contexts(docs)).collect()}
    assert shown == {k: (n, round(d, 9)) for k, (n, d) in want.items() if d >= (0.6 if n >= 3 else 0.85)}
    text = {(i, len(t or "")): t or "" for i, t, _ in rows}
    got = {(r.doc_id, r.spans): r for r in pii.personal_data(docs).collect()}
    assert set(got) == {(i, spans_of(t)) for (i, _), t in text.items()}
    named = {(i, text[k][int(a) : int(b)]) for (i, s) in got for k in text if k[0] == i for f, a, b in (x.split(":") for x in s.split(",") if x) if f in ("removed", "generalised")}
    assert {(0, "Nightjar"), (400, "Zebulon"), (400, "Quartermaine"), (401, "Nightjar"), (None, "Nightjar")} <= named
    assert not any(i in range(100, 160) for i, _ in named)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    after = {r.doc_id: r for r in clean.collect()}
    assert "Nightjar" not in after[0].text and "jay@" not in after[0].text and "Zebulon" not in after[400].text and after[0].n_chars == len(after[0].text) and after[100].text == text[100, len(after[100].text)]
    assert pii.sanitised(docs.limit(0)).count() == 0


def test_terms_beyond_a_broadcast(spark, monkeypatch):
    """Texts are joined to their terms by shuffle where the terms are too large to broadcast."""
    docs = documents(spark, letters())
    whole = sorted(map(str, pii.personal_data(docs).collect()))
    monkeypatch.setattr(pii, "small", lambda df, *_: df)
    assert sorted(map(str, pii.personal_data(docs).collect())) == whole


def test_disclosure_counts_distinct_documents(spark):
    """Form letters with the same words beside a term don't hide it, nor do copies change what it discloses."""
    letters = [(i, f"{prose(30, 800 + i)} please ask Nightjar at jay@example.com about {prose(30, 850 + i)}", "a") for i in range(6)]
    others = [(100 + i, prose(40, 700 + i), "a") for i in range(60)]
    copied = [(1000 + i, letters[0][1].replace("please ask", "Please\nASK") if i % 2 else letters[0][1], "a") for i in range(20)] + [(2000 + i, others[0][1], "a") for i in range(20)]
    found = []
    for rows in (letters + others, letters + others + copied):
        docs = documents(spark, rows)
        found.append({(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosing(docs, pii.contexts(docs)).collect()})
    assert found[0]["email:jay@example.com", "nightjar"] == 1.0 and found[0] == found[1]
    got = {r.doc_id: r.text for r in pii.sanitised(documents(spark, letters + others)).collect()}
    assert all("Nightjar" not in got[i] for i in range(6)) and all(got[i] == t for i, t, _ in others)


def test_terms_and_rows_are_counted_in_one_pass(spark, monkeypatch):
    """Hashes and counts are those of the expressions that the other passes use."""
    rows = letters() + [(500, None, "a"), (501, "ÄÖ\x0bİx ...Straße!\x85\xa0y \x1cz", "a"), (502, "(Word) word WORD.", "a"), (503, "word  WORD (word).", "a")]
    docs = documents(spark, rows)
    for most in (pii.MOST_HELD, 0):
        monkeypatch.setattr(pii, "MOST_HELD", most)
        got = {(r.hash, r.copied): r.n for r in pii.counted(docs).groupBy("hash", "copied").agg(F.sum("n").alias("n")).collect()}
        want = Counter()
        for r in pii._parted(docs).collect():
            want.update([(r.copy, True), *((h, False) for h in r.hashes)])
        assert got == want


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""


def test_license_classifier_on_texts_held_back():
    model, held = licenses.train(), licenses.examples(True)
    right = sum(model.predict(t)[0] == model.families[k] for t, k in held)
    known = [(model.predict(t)[0], model.families[k]) for t, k in held if k < len(licenses.TEMPLATES)]
    assert right >= 0.93 * len(held) and sum(f != k and f != licenses.UNKNOWN for f, k in known) <= 0.02 * len(known)


def test_license_scan(spark, hard):
    model = licenses.train()
    texts = ["All rights reserved.\nReleased under the MIT License.\n" + prose(60, 3).replace("\n", " "), "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "She lost her driving license.", "the license of the restaurant", MIT, BSD, "\n\n a_b \n", prose(40, 6).replace("\n", " ") + "\nSPDX-License-Identifier: MPL-2.0\n" + prose(40, 7).replace("\n", " ")]
    rows = [(30_000 + i, t, "a") for i, t in enumerate(texts)] + hard_rows()
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault((r.doc_id, r.n_paragraphs), r)

    def triples(tokens):
        return {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}

    for i, t, _ in rows:
        parts = licenses.paragraphs_of(t or "")
        want = {}
        for k, lines in enumerate(parts):
            for unit in [" ".join(lines), *(lines if len(lines) > 1 else [])]:
                tokens = licenses.tokens_of(unit)
                family, p = model.predict(tokens)
                if family == licenses.UNKNOWN:
                    continue
                own = triples(tokens)
                shared = max(len(own & (m := triples(licenses.tokens_of(x)))) / min(len(own), len(m)) for x in licenses.TEMPLATES[family])
                want[k, family] = max(want.get((k, family), (0, 0)), (round(shared, 6), round(p, 6)))
        found = got[i, len(parts)].findings
        assert len(found) == len(want)
        for f in found:
            shared, p = want[f.paragraph, f.family]
            assert abs(f.shared - shared) < 2e-6 and abs(f.probability - p) < 2e-5 and f.confirmed == (shared >= licenses.LEAST_SHARED)
    found = {i - 30_000: r.families for (i, _), r in got.items() if i is not None and r.families}
    assert found == {0: "mit,proprietary", 1: "cc-by-nc", 2: "gpl", 3: "apache", 6: "mit", 7: "bsd", 9: "mpl"}
    assert licenses.scan(hard.limit(0)).count() == 0


def test_url_lists(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("l", "block", "bad.org", "add", at(5)), ("l", "block", "bad.org", "remove", at(10)), ("l", "block", "bad.org", "add", at(20)), ("m", "allow", "good.bad.org", "add", at(1)), ("l", "block", "tie.org", "remove", at(3)), ("l", "block", "tie.org", "add", at(3)), ("l", "block", "tie.org", "add", at(3)), ("l", "block", None, "add", at(1))]
    e = spark.createDataFrame(entries, "list string, kind string, domain string, action string, dated string").withColumn("dated", F.col("dated").cast("timestamp_ntz"))
    captures = [(1, "http://BAD.org/x", at(4)), (2, "https://u@a.bad.org:8080/x", at(5)), (3, "http://bad.org", at(10)), (4, "http://bad.org?x", at(25)), (5, "http://good.bad.org/", at(6)), (6, "http://tie.org/", at(3)), (7, None, at(3)), (8, "nonsense", at(3)), (9, "http://bad.org/", None), (2, "https://u@a.bad.org:8080/x", at(5))]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")).withColumn("spans", F.lit(1))
    want = sorted([(1, "kept"), (2, "blocked"), (2, "blocked"), (3, "kept"), (4, "blocked"), (5, "allowed"), (6, "blocked"), (7, "kept"), (8, "kept"), (9, "kept")])
    for most in (100, 0):
        assert sorted((r.page_id, r.verdict) for r in urls.evaluate(c, e, most).collect()) == want
    assert urls.kept(c, e.limit(0)).count() == 10 and urls.evaluate(c.limit(0), e).count() == 0


def test_tool_calls(spark):
    calls = [(1, "a", 1, "search", '{"q": "x", "n": 1}', []), (1, "b", 2, "search", '{"n":"1","q":"x"}', ["a"]), (1, "c", 3, "other", "{}", ["b", "zz"]), (1, "d", 4, "search", "{bad", ["e"]), (1, "e", 5, "search", '{"n": 2}', ["d"]), (2, "a", 1, "search", '{"q":"ä\\"","z":1}', []), (3, None, 1, "search", '{"q":"x"}', []), (2, "a", 1, "search", '{"q":"ä\\"","z":1}', [])]
    results = [(1, "a", 2, "late"), (1, "a", 1, "early"), (1, "x", 9, "lost"), (2, "a", 2, 'q"é'), (2, None, 2, "no")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>").withColumn("level", F.lit(9))
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    s = spark.createDataFrame([("search", "q", "STRING", True), ("search", "n", "BIGINT", False)], "name string, field string, type string, required boolean")
    got = {}
    for x in toolcalls.link(c, r, s).collect():
        got.setdefault((x.conv_id, x.call_id), []).append(x)
    assert json.loads(got[1, "a"][0].message) == {"arguments": {"n": 1, "q": "x"}, "content": "early", "id": "a", "name": "search"}
    assert got[1, "a"][0].message == '{"arguments":{"n":1,"q":"x"},"content":"early","id":"a","name":"search"}' and got[1, "a"][0].problems == "" and got[1, "a"][0].n_results == 2
    assert [got[1, k][0].level for k in "abcde"] == [0, 1, 2, None, None] and [got[1, k][0].position for k in "abc"] == [1, 2, 3]
    assert got[1, "b"][0].problems == "no result,wrong type" and got[1, "c"][0].problems == "no result,missing dependency,unknown tool"
    assert got[1, "d"][0].problems == "no result,cycle,invalid arguments" and got[1, "e"][0].problems == "no result,cycle,missing field"
    assert got[1, "x"][0].problems == "no call" and got[3, None][0].problems == "no identifier,no result"
    assert len(got[2, "a"]) == 2 and got[2, "a"][0].problems == "unknown field" and json.loads(got[2, "a"][0].message)["content"] == 'q"é'
    assert toolcalls.link(c.limit(0), r.limit(0), s).count() == 0


def test_levels_of_any_graph(spark):
    """Against a plain recursion: chains, joins of several, cycles and what hangs on them."""
    dice, rows = random.Random(12), []
    for conv in range(6):
        for i in range(25):
            after = sorted({str(dice.randrange(30)) for _ in range(dice.choice([0, 1, 1, 1, 2, 3]))}) if conv else ([str(i - 1)] if i else [])
            if conv < 4:
                after = [a for a in after if int(a) < i or int(a) >= 25]
            rows.append((conv, str(i), after))
    rows += [(9, "a", ["b"]), (9, "b", ["a"]), (9, "c", ["b"]), (9, "d", ["c", "e"]), (9, "e", []), (9, "f", ["f"]), (9, "g", ["e", "e", None]), (9, "h", ["g", "e"])]
    after = {(c, i): {a for a in w if a and any(x == (c, a) for x in ((r[0], r[1]) for r in rows))} for c, i, w in rows}
    want, moved = {k: 0 for k, w in after.items() if not w}, True
    while moved:
        ready = [k for k, w in after.items() if k not in want and all((k[0], a) in want for a in w)]
        moved = bool(ready)
        want |= {k: 1 + max(want[k[0], a] for a in after[k]) for k in ready}
    got = toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and len(got) == len(want) and max(want.values()) == 24


def test_long_chains_are_whole_or_raise(spark):
    calls = spark.createDataFrame([(1, str(i), [str(i - 1)] if i else []) for i in range(1000)], "conv_id long, call_id string, after array<string>")
    began = time.monotonic()
    assert sorted((int(r.call_id), r.level) for r in toolcalls.levels(calls).collect()) == [(i, i) for i in range(1000)]
    assert time.monotonic() - began < 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    start = spark.createDataFrame([(0, 0)], "root long, id long")
    assert sorted(r.id for r in memory.closure(edges, start).collect()) == list(range(5))
    doubled = spark.createDataFrame([(1, str(i), [str(j) for j in (i - 1, i - 2) if j >= 0]) for i in range(6)], "conv_id long, call_id string, after array<string>")
    with pytest.raises(RuntimeError):
        toolcalls.levels(doubled, most_rounds=3)
    with pytest.raises(RuntimeError):
        memory.closure(edges, start, most_rounds=3)
