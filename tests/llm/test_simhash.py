from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), 42).intdigest() for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints, radius=3):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for i, g in zip(ids, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


@pytest.mark.parametrize("shard_limit", [simhash.SHARD_LIMIT, 8])
def test_groups_agree_with_comparing_all(odd, odd_rows, shard_limit):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    ids = [r[0] for r in odd_rows]
    expected = sorted(
        ((i, f"{p:016x}", g) for i, p, g in zip(ids, prints, plain_groups(ids, prints))), key=repr
    )
    extra = odd.withColumns({"fingerprint": F.lit("x"), "component_id": F.lit(1), "_fp": F.lit(2)})
    got = [tuple(r) for r in simhash.near_duplicates(extra, shard_limit=shard_limit).collect()]
    assert sorted(got, key=repr) == expected


def test_spark_hashes_alike(spark):
    text = "straße ünder ок 日本"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_bk_trees_find_every_link():
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints, tree = [], []
    for number in range(6):
        own = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(6)}
        prints += sorted(own)
        tree += [number] * len(own)
    values, trees = np.array(prints, np.uint64), np.array(tree)
    for radius in (0, 1, 3):
        found = {(int(a), int(b)) for x, y in simhash.Forest(values, trees).links(radius) for a, b in zip(x, y)}
        expected = {
            (i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
            if tree[i] == tree[j] and bin(prints[i] ^ prints[j]).count("1") <= radius
        }
        assert found == expected


def test_crowded_shards_are_cut_and_lose_nothing(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "_fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(df, 3, shard_limit=20)).collect()}
    expected = plain_groups(list(range(len(prints))), prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {}
    for p, g in zip(signed, expected):
        got.setdefault(g, set()).add(roots.get(p, p))
    assert all(len(v) == 1 for v in got.values())
    assert len({next(iter(v)) for v in got.values()}) == len(got)


def test_groups_along_a_path(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, 1001), (1001, 1002), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in (1000, 1001, 1002)}}


def test_one_of_each_group_stays(odd, odd_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    ids = [r[0] for r in odd_rows]
    wanted = {g for g in plain_groups(ids, prints) if g is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(wanted)
    assert got.count(None) == 1


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
