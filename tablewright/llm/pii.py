"""Personal data by weak supervision, in DataFrame expressions alone.

Base spans follow four fixed patterns with their checks. Beside them, wider patterns
give candidates that the base rules miss (written-out addresses, phone numbers without
a country code, IPv6, cards whose checksum fails). Labelers of three kinds vote on
every span: pattern labelers (strict form, shape), gazetteers (top-level domains,
calling and area codes, issuer prefixes, reserved networks) and context (words before
and after, word boundaries). A vote is 1 (personal data), 0 (not) or -1 (abstains).

Only the counts of equal vote patterns leave the executors (at most kinds x 3 ^
labelers rows, whatever the input). On these counts expectation-maximisation estimates
each labeler's reliability, and a logistic span classifier is fitted to the resulting
probabilities. The classifier goes back into the plan as an expression; candidates
reaching ``THRESHOLD`` become spans, base spans always stay.

Positions are code points, ends exclusive. Null texts count as empty and have no
spans. Repeated rows are searched one by one, an empty table gives an empty table.
Very long texts are searched whole; the cost of a text grows with the square of its
spans. Spans that begin at one place are ordered by kind. Input columns named
candidates or spans are replaced, all other names are free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "shape", "gazetteer", "before", "after", "edges")
THRESHOLD = 0.9
ROUNDS, STEPS = 50, 400

# The base patterns, written so that the engine never backtracks over a
# repeated group (possessive where what follows cannot start inside), and never tries
# a start inside a run whose start has failed.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Patterns of the candidates beside the base, by kind.
WIDER = (
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,64}){1,5}",
    r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    None,
    r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
)
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|me|co|eu|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|fi|dk|uk|ie|us|ca|mx|br|ar|cl|au|nz|jp|cn|in|ru|kr|za"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|3(?:0[0-5]|[68])|6(?:011|5|4[4-9])|35|62"
RESERVED = r"(?:0|10|127|22[4-9]|2[345][0-9])\.|192\.168\.|169\.254\."
BEFORE_YES = (
    r"(?:e-?mail|mail|contact|write|correo|courriel|mailto)\W*(?:\w+\W+)?$",
    r"(?:\bip|address|host|server|client|from|login)\W*(?:\w+\W+)?$",
    r"(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\W*(?:\w+\W+)?$",
    r"(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|tel[eé]fono|t[eé]l[eé]phone)\W*(?:\w+\W+)?$",
)
BEFORE_NO = r"(?:version|\bv|release|build|isbn|issn|doi|order|invoice|page|section|chapter|figure|item|sku|serial|part|id)\W*$"
AFTER_YES = r"^\W{0,3}(?:\(?(?:mobile|cell|home|work|office|private|fax)\b|ext\b)"
AFTER_NO = r"^\x20?(?:%|kg|km|cm|mm|eur\b|usd\b|items\b|units\b|pages\b|copies\b)"
#: What every span has at least: no text without a match here holds any.
GATE = r"[0-9@:]|[(\[](?:at|dot)[)\]]|\x20dot\x20"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: int, hit: Column) -> Column:
    """The base checks."""
    if kind == 1:
        return hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == 2:
        return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == 3:
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _possible(kind: int, hit: Column) -> Column:
    """Hits of a base pattern that fail its checks but stay candidates."""
    return F.length(_digits(hit)).between(15, 16) if kind == 2 else F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _votes(kind: int, hit: Column, before: Column, after: Column, base: bool, good: Column) -> list[Column]:
    digits, left, right = _digits(hit), F.lower(F.right(before, F.lit(40))), F.lower(F.left(after, F.lit(24)))
    same = digits.rlike(r"^([0-9])\1*$")
    shape = (
        _vote(hit.rlike(r"^[^@]{2,}@.*\.[A-Za-z]{2,}$"), hit.rlike(r"^[^A-Za-z]*@")),
        _vote(hit.rlike(r"[0-9]{2,}.*[0-9]{2,}|:"), F.lit(True)),
        _vote(F.call_function("luhn_check", digits), F.lit(True)),
        _vote(F.length(digits).between(10, 12) & ~same, same),
    )[kind]
    gazetteer = (
        _vote(F.lower(hit).rlike(rf"(?:\.|dot\)?\]?\x20?)(?:{DOMAINS})$"), F.lit(True)),
        _vote(~hit.rlike(f"^(?:{RESERVED})"), F.lit(True)),
        _vote(digits.rlike(f"^(?:{ISSUERS})") & ~same, F.lit(True)),
        _vote(hit.rlike(rf"^\+(?:{CALLING})") | hit.rlike(r"^\(?[2-9][0-8][0-9]"), F.lit(True)),
    )[kind]
    return [
        _vote(good, F.lit(base)),  # the base pattern with its checks; wider patterns leave it open
        shape,
        gazetteer,
        _vote(left.rlike(BEFORE_YES[kind]), left.rlike(BEFORE_NO)),
        _vote(right.rlike(AFTER_YES), right.rlike(AFTER_NO)),
        _vote(~(left.rlike(r"[\p{L}0-9]$") | right.rlike(r"^[\p{L}0-9]")), F.lit(True)),
    ]


def _found(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """Spans of one pattern: what lies between hits gives their positions and contexts."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), F.slice(gaps, 2, F.greatest(F.size(hits), F.lit(0))), lambda p, after: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), after.alias("after")))
    place = "kind int, start int, end int, base boolean, " + ", ".join(f"{x} int" for x in LABELERS)
    state = f"struct<at: int, spans: array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in place.split(', ')))}>>>"

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        good = F.coalesce(_valid(kind, p["hit"]), F.lit(False)) if base else F.lit(False)
        keep = good | _possible(kind, p["hit"]) if base else F.lit(True)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), good.alias("base"), *(v.alias(n) for n, v in zip(LABELERS, _votes(kind, p["hit"], p["gap"], p["after"], base, good), strict=True)))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(state)
    return F.aggregate(F.filter(pieces, lambda p: p["hit"].isNotNull()), start, add, lambda acc: acc["spans"])


def with_candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``candidates``: base spans and the wider patterns' spans, each with its votes.

    A wider span that overlaps a base span is no candidate.
    """
    given, text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    none = F.filter(_found(F.lit(""), "x", 0, True), lambda s: F.lit(False))
    may = (
        F.contains(text, F.lit("@")),
        text.rlike(r"[0-9]\.[0-9]"),
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        text.rlike(r"\+[0-9]"),
    )
    wider_may = (
        text.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]|\x20dot\x20"),
        text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
        None,
        text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    )
    gate = given.rlike(GATE)  # one scan spares most texts the others
    columns = [F.when(F.col("_gate") & m, _found(text, BASE[k], k, True)).otherwise(none).alias(f"_base{k}") for k, m in enumerate(may)]
    columns += [F.when(F.col("_gate") & m, _found(text, WIDER[k], k, False)).otherwise(none).alias(f"_wider{k}") for k, m in enumerate(wider_may) if m is not None]
    kept = [c for c in df.columns if c.lower() != "candidates"]
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text"), gate.alias("_gate")).select("row", *columns)  # callers' names stay inside the row
    base = F.concat(*(F.col(f"_base{k}") for k in range(4)))
    sure = F.filter(base, lambda s: s["base"])
    rest = F.concat(F.filter(base, lambda s: ~s["base"]), *(F.col(f"_wider{k}") for k in (0, 1, 3)))
    found = found.withColumn("_base0", sure).withColumn("_wider0", rest)
    free = F.filter("_wider0", lambda s: ~F.exists("_base0", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], F.concat("_base0", free).alias("candidates"))


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities (a labeler's share of right votes on either class) and the classifier's weights."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[tuple[str, int], float]
    bias: float

    def probability(self, span: Column) -> Column:
        terms = F.lit(self.bias)
        for (name, value), w in self.weights.items():
            terms = terms + F.when(span[name] == value, w).otherwise(0.0)
        return 1 / (1 + F.exp(-terms))


def fit_patterns(rows: list[tuple[tuple[int, ...], int]]) -> SpanModel:
    """From counted patterns (kind, votes...) to reliabilities by EM, and from their
    probabilities to a logistic classifier over kind and votes."""
    m = len(LABELERS)
    total = sum(n for _, n in rows) or 1
    right = [(0.8, 0.8)] * m
    prior = 0.5
    chance = [0.5] * len(rows)
    for _ in range(ROUNDS):
        for i, (p, _) in enumerate(rows):
            yes, no = math.log(prior), math.log(1 - prior)
            for (a, b), v in zip(right, p[1:], strict=True):
                if v >= 0:
                    yes += math.log(a if v else 1 - a)
                    no += math.log(1 - b if v else b)
            chance[i] = 1 / (1 + math.exp(min(700, no - yes)))
        mass = sum(n * c for (_, n), c in zip(rows, chance, strict=True))
        prior = (mass + 1) / (total + 2)
        for j in range(m):
            a1 = a0 = b1 = b0 = 0.0
            for (p, n), c in zip(rows, chance, strict=True):
                if p[1 + j] == 1:
                    a1, b1 = a1 + n * c, b1 + n * (1 - c)
                elif p[1 + j] == 0:
                    a0, b0 = a0 + n * c, b0 + n * (1 - c)
            # prior counts keep labelers better than chance and off certainty
            right[j] = (min(0.99, max(0.55, (a1 + 8) / (a1 + a0 + 10))), min(0.99, max(0.55, (b0 + 8) / (b1 + b0 + 10))))
    keys = [("kind", k) for k in range(1, len(KINDS))] + [(name, v) for name in LABELERS for v in (0, 1)]
    at = {k: i for i, k in enumerate(keys)}
    seen = [[at[k] for k in (("kind", p[0]), *zip(LABELERS, p[1:], strict=True)) if k in at] for p, _ in rows]
    share = [math.sqrt(n) for _, n in rows]  # frequent patterns count more, rare ones still count
    whole = sum(share) or 1.0
    w, bias = [0.0] * len(keys), 0.0
    for _ in range(STEPS):
        grad, g_bias = [0.001 * x for x in w], 0.0
        for s, n, c in zip(seen, share, chance, strict=True):
            e = n / whole * (1 / (1 + math.exp(-(bias + sum(w[i] for i in s)))) - c)
            g_bias += e
            for i in s:
                grad[i] += e
        bias -= 2.0 * g_bias
        w = [x - 2.0 * g for x, g in zip(w, grad, strict=True)]
    return SpanModel(dict(zip(LABELERS, right, strict=True)), dict(zip(keys, w, strict=True)), bias)


def learn_spans(candidates: DataFrame) -> SpanModel:
    """Fit on the votes of all candidates of all rows."""
    # outer, so that no filter on the array is inferred: it would find all candidates a second time
    s = candidates.select(F.explode_outer("candidates").alias("s")).where("s IS NOT NULL")
    counts = s.groupBy("s.kind", *(f"s.{x}" for x in LABELERS)).agg(F.count("*").alias("n")).collect()
    return fit_patterns(sorted((tuple(r[:-1]), r.n) for r in counts))


def with_spans(candidates: DataFrame, model: SpanModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``with_candidates`` with ``spans`` (kind, start, end, base), in order, instead."""
    kept = F.filter("candidates", lambda s: s["base"] | (model.probability(s) >= threshold))
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    out = candidates.withColumn("spans", F.array_sort(spans))
    return out.drop("candidates")


def find_personal_data(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the array ``spans`` of struct(start, kind, end, base); kind indexes KINDS. Candidates are found once and kept at rest."""
    candidates = cut(with_candidates(df, text_col))
    return with_spans(candidates, learn_spans(candidates), threshold)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with each span (overlapping ones together) replaced by its kind in brackets."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]"))
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return df.withColumn(text_col, F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(text))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    candidates = cut(with_candidates(docs).select("doc_id", "candidates"))
    rows = with_spans(candidates, learn_spans(candidates))
    base = F.filter("spans", lambda s: s["base"])
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
