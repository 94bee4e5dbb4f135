import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm.components import connected_components
from tablewright.llm.simhash import fingerprint_links, link_within, majority, op5_simhash_dedup, shingle_hashes, simhash_components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def flip(rnd, bits):
    return sum(1 << i for i in rnd.sample(range(64), bits))


def brute_components(items, linked):
    items = sorted(items)
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {x: find(x) for x in items}


@pytest.mark.parametrize("text", ["", "  \n", "A b", "one two Three four", "É À b c d", "a\xa0b c d e f", " ".join(map(str, range(3000)))])
def test_fingerprint(text):
    assert int(majority([shingle_hashes(text, 4)])[0]) == brute_fingerprint(text)


def test_vantage_point_join_is_exact():
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(300)]
    near = [b ^ flip(rnd, rnd.randint(1, 6)) for b in base for _ in range(6)]
    fps = np.unique(np.array(base + near, np.uint64))
    home = np.array([rnd.random() < 0.7 for _ in fps])
    want = brute_components(range(len(fps)), lambda a, b: (home[a] or home[b]) and int(fps[a] ^ fps[b]).bit_count() <= 4)
    forest = link_within(fps, home, 4)
    got = {i: int(forest.parent[i]) for i in range(len(fps))}
    assert got == want


def test_shards_lose_no_link(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(150)]
    fps = list({b ^ flip(rnd, k) for b in base for k in (0, 2, 4, 5, 7)})
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    got = {r.node: r.component for r in connected_components(fingerprint_links(reps)).collect()}
    want = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_stars_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    links = spark.createDataFrame(chain + [(5, i) for i in range(6, 40)] + [(7, 7), (3, None), (41, 40), (40, 39)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 42)}
    assert connected_components(links.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(docs, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = op5_simhash_dedup(spark, sf_dir).collect()
    assert len(got) == len(docs) and len(set(want.values())) < len(docs)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in docs}


def test_edge_cases(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (9, " \n", 1), (4, "same words here now", 1), (4, "same words here now", 1), (None, "same words here now", 1)], "doc_id long, text string, fp int")
    got = defaultdict(list)
    for r in simhash_components(df).collect():
        got[r.doc_id].append(r.component_id)
    assert got == {3: [2], 2: [2], 9: [2], 4: [4, 4], None: [4]}
    assert simhash_components(df.limit(0)).count() == 0


def test_xxhash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("some words of text")).alias("h")).first()
    assert np.int64(row.h).view(np.uint64) == xxhash.xxh64_intdigest(b"some words of text", 42)
