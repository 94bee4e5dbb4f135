from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tablewright.llm.common import held_out
from tablewright.llm.language_id import MIN_RATE, SHARE, LanguageModel, identify_languages, learn_languages, ngrams, op1_language_id


def test_ngrams_stay_inside_their_text():
    codes, off = ngrams(pa.array(["abc", "", "d!"]).cast(pa.large_string()))
    grams = [int(c).to_bytes(4, "little").decode() for c in codes]
    assert [grams[a:b] for a, b in zip(off, off[1:])] == [[" abc", "abc ", "bc  "], [], [" d  ", "d   "]]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_languages(docs.where(~held_out()))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "漢字", "x"), (4, "漢字", "x"), (5, "a", "x"), (None, "the and of the", "x")], "doc_id long, text string, Score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify_languages(df, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and all(g[1] in model.languages for g in got[3:])
    assert got[3] == got[4] and got[3][2] == 0.0 and got[-1][1] == "en"
    assert identify_languages(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify_languages(df, None).collect()} == {"und"}
    assert learn_languages(docs.limit(0)) is None


def test_masks_name_every_language_that_has_the_gram():
    a, b = ngrams(pa.array(["hello"]).cast(pa.large_string()))[0], ngrams(pa.array(["hello world"]).cast(pa.large_string()))[0]
    m = LanguageModel.build({"x": a, "y": b}, "x")
    assert all(m.languages_of(a)[0] & 1) and all(m.languages_of(b)[0] & 2)


def grams(text):
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in f" {text.lower()}  ".encode())
    return [data[i : i + 4] for i in range(len(data) - 3)]


def test_against_exact_sets(spark, sf_dir):
    """Sets in place of filters, dictionaries in place of the plan: same languages, close scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL").collect()
    counts = defaultdict(Counter)
    for r in learn:
        counts[r.lang].update(grams(r.text))
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    top = Counter()
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    member = {k: {g for g, x in r.items() if x >= MIN_RATE and x >= SHARE * top[g]} for k, r in rates.items()}
    off = 0
    got = op1_language_id(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        own = grams(texts[r.doc_id] or "")
        n = {k: sum(g in member[k] for g in own) for k in sorted(member)}
        if r.lang_pred == "und":
            continue
        best = max(n, key=n.get)
        off += best != r.lang_pred or abs(r.score - n[best] / max(1, sum(n.values()))) > 0.02
    assert off <= 0.01 * len(got)


def test_every_language_has_its_filter(spark):
    """More languages than a 64-bit word holds, and a text longer than any block."""
    rnd = np.random.default_rng(3)
    words = {f"l{i:03}": ["".join(chr(97 + x) for x in rnd.integers(0, 26, 7)) for _ in range(30)] for i in range(150)}
    rows = [(i * 10 + j, " ".join(rnd.choice(w, 40)), k) for i, (k, w) in enumerate(words.items()) for j in range(2)]
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 150 and model.masks.shape[0] == 3
    asked = [(i, " ".join(rnd.choice(w, 20)), k) for i, (k, w) in enumerate(words.items())] + [(999, " ".join(words["l149"] * 20_000), "l149")]
    got = identify_languages(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang and r.coverage > 0.4 for r in got)
    assert identify_languages(spark.createDataFrame([(1, "zzqx kkjw qqzx wwvk")], "doc_id long, text string"), model).first().coverage < 0.25
