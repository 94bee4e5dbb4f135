"""Conversation structure repair: the cheapest edits that make roles alternate, by lazy weighted determinisation.

The roles of a repaired conversation read ``(s?(ua)+)?``. Four grammar states (nothing
yet, after a system row, after a user row, after an assistant row) hold the cost of
finishing from there; a row turns these four costs into four others. Costs less their
least are one of few vectors, as inserts bound how far they lie apart, so each vector
met becomes a state of a deterministic automaton, and (state, kind of row) is computed
once a task and looked up ever after.

1. Faults of each row: blank, repeat of an earlier row of its conversation, truncated. The
   first row of equals is a window over (conversation, role, digest of the text).
2. Rows without texts come to tasks sorted by conversation and turn. The table is scanned
   from the last row to the first, which gives the cost; the audit follows the tight arcs
   from the first row to the last, against the scan, and takes the least letter of those
   tight. One byte a row is held, as long as the audit itself.
3. Rows with texts are sorted the same way, each conversation behind its audit, and
   stream through: kept, given another role, deleted, or an empty row put in.

Edits: D deletes (cost 4; the only way for blank and repeated rows), I inserts an empty
user or assistant row (3), K keeps (0), R gives a row another role (3, user or assistant);
each undeleted truncated row adds 3.

A conversation's order is its turns, nulls first, ties by role and digest of the text;
rows that are equal in all of these are alike. Null roles and texts count as one space, so
a null text is blank. A null conversation id is a conversation. Very long texts are read
whole; a very long conversation passes through one task row by row, as its audit and
its hash are sequences. An empty table gives an empty one. Other columns of the input are not
kept, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, table

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Grammar states: nothing yet, system, user, assistant; the next role of each (state, role).
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
ACCEPTS = (START, ASSISTANT)
WHITE = " \t\n\x0b\x0c\r"
#: A row's kind: its role's initial (s, u, a, another) times whether it is truncated, or one that must go.
INITIALS, MUST_GO = "sua?", 8


class Automaton:
    """States are normalised cost vectors, made as they are met; ``table`` caches (state, kind) and ``traces`` the arcs taken."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last = self._state([0 if q in ACCEPTS else 10**9 for q in range(4)])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """(state, what was taken off) of four costs, inserts allowed first."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[q][0]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def arcs(self, kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next grammar state) of a row in state q, least letter first, inserts apart."""
        yield "D", DELETE, q
        if kind != MUST_GO:
            role, late = INITIALS[kind // 2], TRUNCATED * (kind % 2)
            if role == "s" and q == START:
                yield "K", late, SYSTEM
            if role == NEXT[q][1][0]:
                yield "K", late, NEXT[q][0]
            yield "R", REROLE + late, NEXT[q][0]

    def before(self, state: int, kind: int) -> tuple[int, int]:
        """(state, weight) in front of a row of this kind whose successor state is ``state``."""
        found = self.table.get((state, kind))
        if found is None:
            after = self.vectors[state]
            found = self.table[state, kind] = self._state([min(cost + after[to] for _, cost, to in self.arcs(kind, q)) for q in range(4)])
        return found

    def step(self, state: int, kind: int, q: int) -> tuple[str, int]:
        """(edits up to and with this row, grammar state after it) along the least tight arcs."""
        found = self.traces.get((state, kind, q))
        if found is None:
            after = self.vectors[state]
            front, weight = self.before(state, kind)
            edits, now = "", q
            while True:
                togo = self.vectors[front][now] + weight
                tight = [(e, to) for e, cost, to in self.arcs(kind, now) if cost + after[to] == togo]
                if INSERT + self.vectors[front][NEXT[now][0]] + weight == togo:
                    tight.append(("I", NEXT[now][0]))
                edit, now = min(tight)
                edits += edit
                if edit != "I":
                    break
            found = self.traces[state, kind, q] = (edits, now)
        return found

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation, one kind a row."""
        state, cost = self.last
        states = [state]
        for kind in reversed(kinds):
            state, weight = self.before(state, kind)
            states.append(state)
            cost += weight
        cost += self.vectors[state][START]
        q, audit = START, []
        for i, kind in enumerate(kinds):
            edits, q = self.step(states[-2 - i], kind, q)
            audit.append(edits)
        while q not in ACCEPTS:
            audit.append("I")
            q = NEXT[q][0]
        return cost, "".join(audit)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``digest`` of the text and ``fault``: blank, duplicate, truncated or null."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    body = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("end", F.right(body, F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("end") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "digest", "end").withColumn("nth", nth).withColumn("fault", fault).drop("end")


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Whole conversations in tasks, rows in the order of ``keys``, nulls first."""
    return df.repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(k) for k in ("conv_id", *keys)])


class _Tally:
    """What is held of one conversation while its rows pass: counts and one byte a row."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.kinds, self.low, self.high, self.turns, self.role = bytearray(), None, None, 0, None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += self.role is not None and self.role + initial not in ("su", "ua", "au")
        self.role = initial
        at = INITIALS.index(initial) if initial in ("s", "u", "a") else 3
        self.kinds.append(MUST_GO if fault in ("blank", "duplicate") else 2 * at + (fault == "truncated"))
        if turn is not None:
            self.turns += turn != self.high  # rows come by turn
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, machine: Automaton) -> tuple:
        cost, audit = machine.repair(bytes(self.kinds))
        return (self.conv, 0 if self.low is None else self.high - self.low + 1 - self.turns, *self.counts.values(), cost, audit)


def _batch(rows: list[tuple], like: pa.RecordBatch, fields: list[T.StructField]) -> pa.RecordBatch:
    """Rows whose first column is the conversation id of ``like``, the others text or numbers as ``fields`` say."""
    kinds = [like.schema.field("conv_id").type, *(pa.string() if f.dataType == T.StringType() else pa.int64() for f in fields[1:])]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in fields])


def plan_repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost (longs) and audit.

    ``conversations`` (conv_id) adds those that have no rows; they get zeros and an empty audit.
    """
    light = judged(rows)
    if conversations is not None:
        light = light.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)  # a null role: no row
    schema = T.StructType([light.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, held, batch = Automaton(), None, None
        for batch in batches:
            done = []
            for conv, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault")), strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        done.append(held.row(machine))
                    held = _Tally(conv)
                if role is not None:
                    held.add(turn, role, fault)
            yield _batch(done, batch, schema.fields)
        if held is not None:
            yield _batch([held.row(machine)], batch, schema.fields)

    # of equal rows the one that is no repeat comes first
    return in_order(light, "turn", "role", "digest", "nth").select("conv_id", "turn", "role", "fault").mapInArrow(run, schema)


def apply_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, nth, edit, role, text), each conversation whole and in order in one task."""
    text = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    text = text.withColumn("digest", F.sha2("text", 256)).withColumn("kind", F.lit(1))
    both = text.unionByName(plans.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text")), allowMissingColumns=True)
    schema = T.StructType([both.schema["conv_id"], T.StructField("nth", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, nth, q = "", 0, 0, START
        for batch in batches:
            done = []
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    audit, at, nth, q = text, 0, 0, START
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        q = SYSTEM if q == START and role[:1] == "s" else NEXT[q][0]
                    elif edit == "R":
                        q, role = NEXT[q]
                    if edit != "D":
                        done.append((conv, nth, edit, role, text))
                        nth += 1
                while audit[at : at + 1] == "I":
                    q, role = NEXT[q]
                    done.append((conv, nth, "I", role, ""))
                    at, nth = at + 1, nth + 1
            yield _batch(done, batch, schema.fields)

    return in_order(both, "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text").mapInArrow(run, schema)


def hash_conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that lie as apply_repairs leaves them; texts stream through, nothing is gathered."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv, batch = None, None, None
        for batch in batches:
            done = []
            for at, nth, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "nth", "role", "text")), strict=True):
                if nth == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    digest, conv = hashlib.sha256(), at
                digest.update(f"{role}:{text}".encode() if nth == 0 else f"\n{role}:{text}".encode())
            yield _batch(done, batch, schema.fields)
        if digest is not None:
            yield _batch([(conv, digest.hexdigest())], batch, schema.fields)

    return repaired.select("conv_id", "nth", "role", "text").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32("conv_id:turn") mod 20: 0 drops, 1 empties, 2 strips .!?, 3 repeats, 4 sets role user."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("m"))
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("m") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("m") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("m <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damage(given)
    plans = cut(plan_repairs(rows, given.select("conv_id")))
    hashes = hash_conversations(apply_repairs(rows, plans)).withColumnRenamed("conv_id", "id")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(*plans.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
