import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm.importance import crc32_slices, feature_buckets, op13_importance_resampling, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_run=1):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return [" ".join(w[i : i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=10, min_words=20, max_run=1, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    held = [(i, *features(t, max_run)) for i, t in docs]
    s, t = Counter(bucket(f) for _, fs, _ in held for f in fs), Counter(bucket(f) for x in target for f in features(x, max_run)[0])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, fs, words in held:
        g = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs)]
        w = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    pool = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(pool) // 100
    ranks = {id(r): n + 1 for n, r in enumerate(pool[:k])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = op13_importance_resampling(spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert rows(got) == brute(docs, target)


@pytest.mark.parametrize("max_run", [1, 2, 3])
def test_runs_of_words_edge_texts_and_clashing_names(spark, max_run):
    texts = ["", None, "One", "a b  c--d É日本 x9", "A\nb\x00c" * 9, "w" * 5000, "same words here " * 9, "ÀB z" * 400]
    docs = [(i, t) for i, t in enumerate(texts)] + [(50 + i, f"alpha beta w{i} gamma" * 3) for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, kept string, score int")
    target = ["alpha gamma", None, "same words"]
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, min_words=3, max_run=max_run)
    assert "kept" in got.columns and {r.kept for r in got.collect()} == {"x"}
    assert rows(got) == brute(docs, target, 30, 3, max_run)


def test_repeated_rows_null_ids_and_ties(spark):
    text = "one two three four"
    docs = [(7, text)] * 30 + [(None, text)] * 30 + [(i, text) for i in range(20)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(text,)], "text string"), 100, 1)
    assert rows(got) == brute(docs, [text], 100, 1)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 81))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 20)] * 10, "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in resample(some, none).collect()) == [0] * 9 + [1]


def test_checksums_of_slices():
    data = np.frombuffer(("abc" * 400 + "é").encode(), np.uint8)
    start, end = np.array([0, 1, 5, 0, 7, 7, 3]), np.array([3, 1, 53, 1200, 60, 55, 1202])
    assert crc32_slices(data, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
    owner, bucket, words = feature_buckets(pa.array(["ab", "cd", "", "e f"], pa.large_string()), 1, 1 << 32)
    assert owner.tolist() == [0, 1, 3, 3] and words.tolist() == [1, 1, 0, 2] and bucket[1] == zlib.crc32(b"cd")
