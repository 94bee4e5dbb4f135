import math
import zlib

import numpy as np
import pyarrow as pa

from tablewright.llm.quality import STRIDE, WIDTH, ByteNetwork, lay_out, learn_quality, op4_quality, repeats, score_quality


def test_chunks_cover_every_byte():
    for n in (0, 1, WIDTH, WIDTH + 1, 100):
        _, first, chunks = lay_out(np.array([0, n]), np.full(n, 65, np.uint8))
        assert chunks[0] >= 1 and WIDTH + STRIDE * (chunks[0] - 1) >= n > WIDTH + STRIDE * (chunks[0] - 2) - STRIDE or chunks[0] == 1


def test_scores_do_not_depend_on_neighbours():
    net = ByteNetwork.fresh()
    texts = ["", "a", "abcabcabcabcabcabc", "x" * 500, "plain words here", "ab\0\0\0\0\0\0\0\0\0\0", "abcabcabcabcabcabc"]
    together = net.scores(pa.array(texts, pa.large_string()))
    alone = [net.scores(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_repeats_are_found():
    text = b"word word word word and more"
    laid, first, n = lay_out(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    seen = repeats(laid, int(first[0] + n[0]))[first[0] :]
    assert not seen[0] and seen[2]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.96


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "text", 1), (3, "text", 1), (None, "text", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id long, quality int")
    assert learn_quality(docs, labels) == 1.0 and learn_quality(docs, labels.limit(0)) == 0.5
    model = learn_quality(docs, labels.unionAll(spark.createDataFrame([(2, 0)], labels.schema)))
    got = score_quality(docs, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and len({r.score for r in got[2:]}) == 1
    assert score_quality(docs.limit(0), model).count() == 0


def slow_score(net, text):
    """The network's definition, one number at a time."""
    data = text.encode()
    chunks = max(1, -(-(len(data) - WIDTH) // STRIDE) + 1)
    laid = bytes(64) + data + bytes(WIDTH * 2)
    best = [0.0] * net.filters.shape[1]
    for c in range(chunks):
        at = 64 + c * STRIDE
        gram = laid[at : at + 8]
        again = any(gram) and any(laid[at - lag : at - lag + 8] == gram for lag in range(2, 33))
        x = [float(v) for b in laid[at : at + WIDTH] for v in net.embedding[b]] + [float(again)]
        for f in range(len(best)):
            best[f] = max(best[f], sum(a * float(w) for a, w in zip(x, net.filters[:, f], strict=True)) + float(net.filter_bias[f]))
    return 1 / (1 + math.exp(-(sum(b * float(w) for b, w in zip(best, net.weights, strict=True)) + net.bias)))


def test_scores_against_brute_force():
    net = ByteNetwork.fresh(5)
    texts = ["", "a", "abcabcabcabcabcabcabcabc", "plain words, and some more of them", "Ünïcode — ok", "x" * 301]
    assert np.allclose(net.scores(pa.array(texts, pa.large_string())), [slow_score(net, t) for t in texts], atol=1e-5)


def test_repeated_ids_and_very_long_texts(spark):
    """One id with very many rows teaches once; long texts teach by windows and are scored to the end."""
    rows = [(1, f"good plain text {i}") for i in range(3000)] + [(i, "good plain text" if i % 2 else "@@## !!" * 5) for i in range(2, 60)] + [(60, "good plain text " * 40_000), (61, "@@## !!" * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if 1 < i < 60 else int(i != 61)) for i in range(1, 62)] * 2, "doc_id long, quality int")
    model = learn_quality(docs, labels)
    got = {r.doc_id: r.predicted for r in score_quality(docs, model).collect()}
    assert got[1] == 1 and got[60] == 1 and got[61] == 0
