import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm.packing import knapsack, op7_packing, pack, plan, solve_patterns
from tablewright.llm.pretokens import default_path


def test_knapsack_against_recursion():
    rnd = np.random.default_rng(1)
    values = rnd.random(9)
    best = [0.0]
    for c in range(1, 21):
        best.append(max([best[c - 1], *(values[i - 1] + best[c - i] for i in range(1, 10) if i <= c)]))
    got, counts = knapsack(values, 20)
    assert got == pytest.approx(best[20]) and (counts * values).sum() == pytest.approx(got)
    assert (counts * np.arange(1, 10)).sum() <= 20


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_all_pieces_near_the_bound(seed):
    rnd = np.random.default_rng(seed)
    demand = rnd.integers(0, 400, 64) * (rnd.random(64) < 0.8)
    made = plan(demand)
    assert (sum(p * n for p, n in made) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in made)
    lp = sum(x for p, x in solve_patterns(demand) if p.min() >= 0)
    assert lp - 1e-3 <= sum(n for _, n in made) <= lp + 12
    assert lp >= (demand * np.arange(1, 65)).sum() / 64 - 1e-6
    assert plan(np.zeros(8, np.int64)) == []


@pytest.mark.parametrize("kind", range(4))
def test_solver_on_sparse_histograms(kind):
    """Small demands make bases degenerate; the program's answer must still be the demand, within its bound."""
    sizes = np.arange(1, 257)
    for seed in range(25 if kind else 5):
        rnd = np.random.default_rng((kind, seed))
        n = int(rnd.integers(5, 3000))
        drawn = (
            lambda: rnd.integers(1, 257, n), lambda: np.exp(rnd.normal(3.2, 0.9, n)).astype(int) + 1, lambda: rnd.exponential(30, n).astype(int) + 1,
            lambda: np.where(rnd.random(n) < 0.3, 256, rnd.geometric(0.05, n)),
        )[kind]()
        demand = np.bincount(np.clip(drawn, 1, 256) - 1, minlength=256)
        got = solve_patterns(demand)
        assert np.abs(sum(p * x for p, x in got) - demand).max() <= 1e-6 * demand.max()
        assert all((p * sizes).sum() <= 256 for p, _ in got)
        if seed < 3:
            made, lp = plan(demand), sum(x for p, x in got if p.min() >= 0)
            assert (sum(p * k for p, k in made) == demand).all() and sum(k for _, k in made) <= lp + 6
            assert lp >= (demand * sizes).sum() / 256 - 1e-6


def check(rows, texts):
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and len(part) == r.length > 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(by_seq))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op7_packing(spark, sf).collect(), texts) > 0.97


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a", 5: "<|endoftext|> x"}
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in texts.items()], "doc_id long, text string, length int, rank int")
    check(pack(df).collect(), texts)
    assert pack(df.limit(0)).count() == 0
    taken = df.selectExpr("doc_id", "text", "0 AS start", "'x' AS class", "1 AS salt", "2 AS sequence_id", "3 AS offset", "4 AS ids_crc32")
    check(pack(taken).collect(), texts)
    odd = pack(df, capacity=100).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 100 for r in odd)
    twice = pack(df.where("doc_id = 4").unionAll(df.where("doc_id = 4"))).collect()
    assert sorted((r.sequence_id, r.offset) for r in twice) == [(0, 0), (0, twice[0].length)]
