import random
import re
from collections import Counter, defaultdict

from tablewright.llm import line_dedup
from tablewright.llm.line_dedup import drop_recurring_lines, op10_line_dedup

NO = 10**18  # stands for a null id


def masked(line):
    return tuple("<*>" if re.search(r"\d", w) else w for w in line.split())


def brute(docs, min_docs=3):
    """docs: (id, text) pairs. The rule of the module's text over dictionaries, in one place."""
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(m := masked(line)) >= 3:
                holders[m].add(NO if i is None else i)
    total, token = Counter(), Counter()
    for m, who in holders.items():
        leaf = (len(m), m[:3])
        total[leaf] += len(who)
        for at, t in enumerate(m):
            token[leaf, at, t] += len(who)
    forms, found = {}, defaultdict(set)
    for m, who in holders.items():
        leaf = (len(m), m[:3])
        for level, share in enumerate((0, 1 / 16, 1 / 2)):
            made = tuple(t if t == "<*>" or not level or token[leaf, at, t] >= share * total[leaf] else "<*>" for at, t in enumerate(m))
            fixed, before = (sum(t != "<*>" for t in x) for x in (made, m))
            if fixed >= 3 and before - fixed <= 0.3 * len(m) + 1e-9:
                forms[m, level] = (level, leaf, made)
                found[forms[m, level]] |= who
    keeper = {}
    for m in holders:
        for level in range(3):
            who = found.get(forms.get((m, level)), ())
            if len(who) >= (2 if level == 0 and len(m) > 50 else min_docs):
                keeper[m] = min(who)
    out = []
    for i, text in docs:
        lines = text.split("\n") if text else []
        kept = [x for x in lines if (m := masked(x)) not in keeper or (keeper[m] == i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if text else text))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(op10_line_dedup(spark, sf))
    assert got == brute(docs) and sum(v[2] for v in got) > 20


def test_same_rows_by_shuffle(spark, sf_dir, monkeypatch):
    """Tables of leaves and lines too long to be broadcast."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CASE WHEN doc_id % 7 > 0 THEN doc_id END AS doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(drop_recurring_lines(docs)) == want
    monkeypatch.setattr(line_dedup, "FEW_LEAVES", 0)
    monkeypatch.setattr(line_dedup, "FEW_LINES", -1)
    assert rows_of(drop_recurring_lines(docs)) == want


def test_edge_cases(spark):
    line = "Order 12 shipped to the customer today"
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"{line}\nunique text of one"), (2, line.replace("12", "99")), (3, f"a b\n\n{line.replace('12', 'x7')}\na b"), (4, None), (5, ""), (None, line), (None, None), (6, "a b"), (7, "a b"), (2, "twice the id"), (8, long), (9, f"{long}\nmore"), (10, "so long a line " * 30_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, N_lines string, _doc int, _gone int, line int, row int")
    out = drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "_doc", "_gone", "line", "row", "n_lines", "n_dropped"]
    got = rows_of(out)
    assert got == brute(rows)
    by = {(r[0], r[1]): r for r in got}
    assert by[2, 1] and by[9, 2][3] == "more" and by[8, 1][3] == long and by[None, 1][3] == "" and by[1, 2][2] == 0
    assert drop_recurring_lines(df.limit(0)).count() == 0
    assert {r.n_dropped for r in drop_recurring_lines(df.where("doc_id < 4"), keep_one=False).where("text LIKE '%shipped%'").collect()} == set()


def test_one_rule_at_every_size(spark, monkeypatch):
    """One template with 4500 variants of a field beside lines of other templates, in one leaf and over groups of any size."""
    rnd = random.Random(4)
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"text of its own {letters(i)} q{letters(i)}\nthis message was sent to {letters(i)} by the office today") for i in range(4500)]
    rows += [(5000 + i, "this message was " + " ".join(rnd.choice(["red", "blue", "sent", "office", letters(rnd.randrange(4000))]) for _ in range(7))) for i in range(500)]
    want = brute(rows)
    assert {r[0] for r in want if "office today" in r[3]} == {0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(drop_recurring_lines(df)) == want
    monkeypatch.setattr(line_dedup, "DEALT", 50)
    assert rows_of(drop_recurring_lines(df)) == want
