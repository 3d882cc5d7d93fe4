"""Best-fit packing against a plain search over all bins."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def follows_the_rule(pieces, capacity):
    """Each piece (n, key, groups, bin), in order, is in the tightest bin of all compatible ones, or in a new one if there is none."""
    state: dict[int, tuple[int, set, set]] = {}
    for n, key, groups, b in pieces:
        compatible = [room for room, keys, held in state.values() if room >= n and key not in keys and not held & set(groups)]
        room, keys, held = state.get(b, (capacity, set(), set()))
        if b in state:
            assert room == min(compatible) and key not in keys and not held & set(groups)
        else:
            assert not compatible
        state[b] = (room - n, keys | {key}, held | set(groups))
    assert all(room >= 0 for room, *_ in state.values())


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_takes_the_tightest_compatible_bin(seed):
    dice = random.Random(seed)
    rows = [(i, dice.choice("aaabcdefg"), [7_000 + i] + [dice.randrange(120) for _ in range(dice.choice([0, 0, 1, 3]))], 0, dice.randrange(1, 60)) for i in range(300)]
    out = packing.pack_shard(pd.DataFrame(rows, columns=["doc_id", "key", "groups", "piece", "n"]), 64)
    follows_the_rule(zip(out.n, out["key"], out.groups, out.bin), 64)
    assert (out.groupby("bin").n.sum() == out.groupby("bin").bin_words.first()).all()


def test_many_clusters_and_copies():
    pdf = pd.DataFrame([(i, str(i % 3), [i // 2], 0, 5) for i in range(1000)], columns=["doc_id", "key", "groups", "piece", "n"])
    out = packing.pack_shard(pdf, 20)
    assert len(out) == 1000
    assert out.assign(cluster=[g[0] for g in out.groups]).groupby(["bin", "cluster"]).size().max() == 1 and out.groupby(["bin", "key"]).size().max() == 1


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_all_shards_against_the_rule(spark):
    """Whole results, in shards of 40: each shard obeys the rule, and near copies at 0.8 never share a bin."""
    dice, rows = random.Random(2), []
    words = ["".join(dice.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    for i in range(60):
        base = [dice.choice(words) for _ in range(dice.randrange(40, 200))]
        for j in range(4):
            changed = list(base)
            for _ in range(j // 2):
                changed[dice.randrange(len(changed))] = "other"
            rows.append((10 * i + j, " ".join(changed).upper() if j == 1 else "\n".join(changed), f"s{dice.randrange(40)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=256, shard_rows=40).toPandas()
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    assert sorted(got.doc_id) == sorted(text) and got.bin_words.max() <= 256
    sets = {i: shingles(t) for i, t in text.items()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    held = got.groupby("bin_id").doc_id.apply(sorted)
    assert len(near) > 100 and not any((a, b) in near for ids in held for a in ids for b in ids if a < b)
    groups = {i: packing.copy_groups(t.lower().encode().split()) for i, t in text.items()}
    shards = got.assign(shard=got.bin_id // 2**32).groupby("shard")
    assert len(shards) == 6
    for _, part in shards:
        again = packing.pack_shard(pd.DataFrame({"doc_id": part.doc_id, "key": ["0" + source[i] for i in part.doc_id], "groups": [groups[i] for i in part.doc_id], "piece": part.piece, "n": part.n_words}), 256)
        follows_the_rule(zip(again.n, again["key"], again.groups, again.bin), 256)
        assert dict(zip(again.doc_id, again.bin)) == dict(zip(part.doc_id, part.bin_id % 2**32))


def test_equal_ids_are_spread(spark):
    """No shard takes all rows of a null id, or of a row that is repeated again and again."""
    for text in ("concat('text number ', id)", "'the same text'"):
        docs = spark.range(600).selectExpr("cast(null as long) as doc_id", f"{text} as text", "cast(id as string) as source")
        got = packing.pack(docs, capacity=20, shard_rows=100).groupBy(F.shiftright("bin_id", 32).alias("shard")).count().collect()
        assert len(got) == 6 and max(r["count"] for r in got) <= 150


def test_edge_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, " ".join(["w"] * 45), None), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as bin", "2 as n", "3 as shard")
    got = packing.pack(docs, capacity=20).collect()
    assert sorted((r.doc_id or 0, r.piece, r.n_words) for r in got) == [(0, 0, 1), (1, 0, 3), (1, 0, 3), (2, 0, 0), (3, 0, 0), (4, 0, 20), (4, 1, 20), (4, 2, 5)]
    assert len({r.bin_id for r in got if r.doc_id == 1}) == 2 and all((r.bin_id is None) == (r.n_words == 0) for r in got)
    assert packing.pack(docs.limit(0)).count() == 0
