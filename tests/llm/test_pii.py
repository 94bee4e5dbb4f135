import hashlib
import random
import re

from pyspark.sql import functions as F

from tablewright.llm.pii import KINDS, LABELERS, find_personal_data, fit_patterns, op9_personal_data, redact

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ODD = [
    None, "", "a@b.c", "a@b.c%d@e.f@g.h", "x@y", "é a.b+c@d-e.f.g. é@x.yy", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255 0000000001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112",
    "+1 (555) 123-4567 + 12345678 +49 30 1234567890123", "+1+1+1 555", "🙂 +1 (988) 555-2485 é 10.0.0.1", "@" * 50 + "a@b.cd", "4111--1111", "9" * 30, "tel 555-123-4567 and (212) 555 0199 mail joe (at) site (dot) com",
    "a@b..c a@.b.c a@b.c-", "00000000000000 4-2-4-2-4-2-4-2-4-2-4-2-4-2-4-2",
]


def test_base_spans(spark):
    rnd = random.Random(9)
    pool = [*"1234567890..--  +@()aZ%é_\n", "@a.b", "+1 ", "4111111111111111", "10.1.2.3", "255"]
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 80))) for _ in range(600)]
    rows = find_personal_data(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == brute(r.text), repr(r.text)


def test_long_texts_do_not_overflow(spark):
    texts = ["1" * 12_000, "1-" * 12_000, "a" * 6_000, "1." * 12_000, "a@" + "b." * 12_000 + "c", "+" + "1 " * 12_000, "a." * 3_000]
    rows = find_personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.base] for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def test_candidates_are_added_and_redacted(spark):
    text = "Please call phone 212-555-0199 or write to mail joe (at) site (dot) com now. " + "Version 1.2.3.4 of part 123 456 7890."
    base = "mail ann@site.com or phone +1 (212) 555-0123, server 81.2.69.142, card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text)] + [(i, base) for i in range(2, 60)] + [(99, None)], "doc_id long, text string")
    found = find_personal_data(df)
    got = {r.doc_id: r.text for r in redact(found).collect()}
    assert "[phone]" in got[1] and "[email]" in got[1] and "212-555-0199" not in got[1]
    assert got[2] == "mail [email] or phone [phone], server [ip], card [card]." and got[99] is None
    assert redact(found.limit(0)).count() == 0
    assert not [x for x in found.columns if x.startswith("_")]


def test_reliabilities_follow_the_votes():
    good = ((0, 1, 1, 1, -1, -1, 1), 500)
    bad = ((0, -1, 0, 0, 0, -1, 1), 500)
    model = fit_patterns([good, bad, ((0, -1, 1, 1, 1, -1, 1), 50)])
    assert model.reliability["shape"][0] > 0.9 and model.reliability["shape"][1] > 0.9
    assert model.reliability["edges"][1] < 0.6
    score = lambda p: model.bias + sum(model.weights.get(k, 0) for k in (("kind", p[0]), *zip(LABELERS, p[1:])))
    assert score(good[0]) > 0 > score(bad[0])
    assert fit_patterns([]).bias == 0.0


def test_plan_is_native(spark, sf_dir):
    plan = op9_personal_data(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F is not None
