import hashlib
import random
import re
import zlib

import pytest

from tablewright.llm.conversations import Automaton, apply_repairs, op12_conversation_repair, plan_repairs

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    """(initial, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def best(marks):
    """Least (cost, audit) by plain forward search over (rows read, last role put out)."""
    layer = {"": (0, "")}

    def better(d, q, v):
        if q not in d or v < d[q]:
            d[q] = v

    def inserted(layer):
        out = dict(layer)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                better(out, NEXT[q], (c + 3, a + "I"))
        return out

    for initial, fault in marks:
        after = {}
        for q, (c, a) in inserted(layer).items():
            better(after, q, (c + 4, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 * (fault == "truncated")
            if initial == NEXT[q] or (initial == "s" and q == ""):
                better(after, initial, (c + late, a + "K"))
            better(after, NEXT[q], (c + 3 + late, a + "R"))
        layer = after
    return min(v for q, v in inserted(layer).items() if q in ("", "a"))


def brute(given, damaged=True):
    convs = {}
    for conv, turn, role, text in given:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if m == 1:
            text = ""
        if m == 2:
            text = re.sub("[.!?]", "", text)
        if m == 4:
            role = "user"
        rows.extend([(turn, role, text)] * {0: 0, 3: 2}.get(m, 1))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        marks = faults(rows)
        kinds = [f for _, f in marks]
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = best(marks)
        q, left, lines = "", iter(rows), []
        for e in audit:
            row = next(left) if e != "I" else (None, "", "")
            if e == "D":
                continue
            q = "s" if e == "K" and q == "" and row[1][:1] == "s" else NEXT[q]
            lines.append(f"{row[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[q]}:{row[2]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_brute_force(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op12_conversation_repair(spark, sf_dir)
    assert dict(df.dtypes) == {"conv_id": "bigint", **dict.fromkeys(COLUMNS[:6], "bigint"), "audit": "string", "repaired_sha256": "string"}
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert got == {c: v[:8] for c, v in brute(given).items()}


def odd_rows(seed):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user"]
    texts = ["Yes.", "No", " ", "", None, "Why?\n", "...", "é", "end!\t ", "x" * 9]
    return [(rnd.choice([None, *range(25)]), rnd.choice([None, *range(-3, 6), 40]), rnd.choice(roles), rnd.choice(texts)) for _ in range(300)]


@pytest.mark.parametrize("seed", range(2))
def test_nulls_ties_repeats_and_odd_roles(spark, tmp_path, seed):
    given = odd_rows(seed)
    spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: v[:8] for c, v in brute(given).items()}


def test_repaired_rows_come_whole_and_in_order(spark):
    given = odd_rows(7) + [(99, i, ("user", "assistant")[i % 2], f"line {i}." + "long " * 40_000 * (i == 3)) for i in range(3000)]
    df = spark.createDataFrame([(*g, 1) for g in given], "conv_id long, turn long, role string, text string, nth int")
    plans = plan_repairs(df)
    got = {}
    for r in sorted(apply_repairs(df, plans).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.nth)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: v[8] for c, v in brute(given, False).items() if v[8]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_conversation_repair(spark, str(tmp_path)).count() == 0


def test_automaton_is_small_and_exact():
    rnd, machine = random.Random(5), Automaton()
    for _ in range(3000):
        marks = [(rnd.choice("suat"), rnd.choice([None, None, "blank", "truncated"])) for _ in range(rnd.randint(0, 12))]
        kinds = bytes(8 if f == "blank" else 2 * "suat".index(i) + (f == "truncated") for i, f in marks)
        assert machine.repair(kinds) == best(marks)
    assert len(machine.vectors) < 300
