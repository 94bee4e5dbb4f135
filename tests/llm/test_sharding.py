import random
import zlib
from collections import Counter, defaultdict

import pytest

from tablewright.llm.sharding import longest_first, op11_sharding, shard


def check(got, docs, shards):
    """Sizes, checksums, groups together, slots gapless; returns the loads."""
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    slots, where, loads = defaultdict(list), defaultdict(set), Counter({s: 0 for s in range(shards)})
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return loads


def groups(docs):
    sizes = Counter()
    for _, t in docs:
        sizes[t or ""] += len((t or "").encode()) + 1
    return sizes


def test_query_keeps_groups_and_balances(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = op11_sharding(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    loads = check(got, docs, 16)
    exact = longest_first([(n, t) for t, n in groups(docs).items()], 16)
    best = Counter()
    for t, n in groups(docs).items():
        best[exact[t]] += n
    assert max(loads.values()) <= max(best.values()) * 1.02


def test_many_small_groups_are_near_equal(spark):
    rnd = random.Random(3)
    docs = [(i, "x" * rnd.randint(1, 300) + str(i % 4000)) for i in range(6000)]
    loads = check(shard(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect(), docs, 5)
    assert max(loads.values()) - min(loads.values()) <= max(groups(docs).values())


def test_hot_group_nulls_ties_and_clashing_names(spark):
    docs = [(i, "the same text") for i in range(700)] + [(None, None), (None, ""), (1, None), (5, "é")] + [(9, "twice")] * 2 + [(100, "long " * 200_000)] + [(i, f"other {i}") for i in range(900)]
    df = spark.createDataFrame([(i, t, "keep", 3, 4) for i, t in docs], "doc_id long, text string, mark string, slot int, digest int").repartition(7)
    got = shard(df, 4)
    assert set(got.columns) == {"doc_id", "mark", "digest", "size", "text_crc32", "shard", "slot"}
    got = got.collect()
    assert {(r["mark"], r["digest"]) for r in got} == {("keep", 4)}
    loads = check(got, docs, 4)
    assert max(loads.values()) == max(groups(docs).values())  # the large text has a shard of its own


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_heap_is_the_plain_rule(seed):
    rnd = random.Random(seed)
    units = [(rnd.choice([5, 5, 7, rnd.randint(1, 99)]), f"u{i}") for i in range(200)]
    loads, want = [0] * 7, {}
    for size, key in sorted(units, key=lambda u: (-u[0], u[1])):
        s = min(range(7), key=lambda j: (loads[j], j))
        want[key], loads[s] = s, loads[s] + size
    assert longest_first(units, 7) == want
