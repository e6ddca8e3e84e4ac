"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates come from strict and from looser patterns. Three labelers vote for, against or not at all: the checks of the pattern,
a gazetteer (domains, card issuers, country codes, reserved networks) and the words before the span. What the votes look like is
counted over all documents; from these counts, a table of bounded size, EM finds how far each labeler can be trusted, and its
posteriors train a naive Bayes classifier over votes, length and edges. Spans of the strict patterns that pass their checks always stay.
Everything that touches texts is DataFrame functions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import before_each, field, let, whole

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, NEUTRAL = "\x01", "\x02", "\x03"
BEFORE = 32  # characters of context

#: (kind, strict, what a text must hold to be searched, pattern). Possessive loops keep Java from recursing on long matches.
#: A local part may only start where a run of its characters starts, or right behind the match before.
PATTERNS = (
    ("email", True, "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[ -]?[0-9]){15}", r"[0-9][0-9 -]*+"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, r"(?i)[\[( ]at[\]) ]", r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}+ ?(?:\[at\]|\(at\)| at ) ?[a-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)| dot ) ?[a-z]{2,10}\b"),
    ("ip", False, ":[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", False, r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?:[0-9]{13,15}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("phone", False, r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Common top-level domains.
DOMAINS = "com net org edu gov mil int info biz io co de fr es it nl uk eu us ca au jp cn br ru ch at be se no dk fi pl".split()
#: Country calling codes.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: First digits of card numbers by issuer.
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|62"
#: Networks that belong to nobody.
RESERVED = r"0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|2[3-5][0-9]\."
FOR = {"email": "mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|login from", "card": "card|visa|master|amex|credit|payment",
       "phone": "phone|\\btel|call|mobile|fax|cell|whatsapp|dial"}
AGAINST = {"email": "user-agent|package", "ip": r"version|\bv\.?\s*$|release|build|section|chapter", "card": "isbn|order|invoice|serial|token|hash|key|sha|id",
           "phone": "isbn|version|order|invoice|serial|part no"}
FEATURES = ("pattern", "gazetteer", "context", "size", "edge")
ROUNDS = 40


def marked(text: Column, pattern: str, kind: str) -> Column:
    """The text with each match between OPEN and CLOSE; marks that the text itself holds become NEUTRAL."""
    plain = F.translate(text, OPEN + CLOSE, NEUTRAL * 2)
    if kind == "card":  # what is left of spaces and hyphens stands between two digits
        plain = F.regexp_replace(plain, "(?<![0-9])[ -]|[ -](?![0-9])", NEUTRAL)
    return F.regexp_replace(plain, pattern, f"{OPEN}$0{CLOSE}")


def _found(text: Column, number: int, strict: bool, probe: str, pattern: str) -> Column:
    """array<struct<kind, strict, start, end, match, before, after>>: matches from left to right, places in code points.

    The marked text is cut before each match; where a match starts is the sum of the lengths before it.
    """
    kind = KINDS[number]
    unit = "struct<kind:int,strict:boolean,start:bigint,end:bigint,match:string,before:string,after:string>"
    none = F.array().cast(f"array<{unit}>")
    rest = lambda part: F.substring_index(part, CLOSE, -1)
    rest_of = lambda part, i: F.when((i > 0) & (F.length(rest(part)) == 0), F.lit(" ")).otherwise(F.right(rest(part), F.lit(BEFORE)))

    def spans(parts: Column, starts: Column) -> Column:
        def span(part: Column, i: Column) -> Column:
            match = F.substring_index(part, CLOSE, 1)
            return F.struct(F.lit(number).alias("kind"), F.lit(strict).alias("strict"), F.get(starts, i + 1).alias("start"),
                            (F.get(starts, i + 1) + F.length(match)).alias("end"), match.alias("match"), rest_of(F.get(parts, i), i).alias("before"),
                            F.substring(rest(part), 1, 1).alias("after"))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), span).cast(f"array<{unit}>")

    def cut(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p, i: (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))  # without its mark
        starts = before_each(sizes, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(parts) > 1, let(starts, lambda at: spans(parts, at))).otherwise(none)

    parts = F.split(marked(text, pattern, kind if strict else ""), OPEN, -1)
    return F.when(F.rlike(text, F.lit(probe)), let(parts, cut)).otherwise(none)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """The checks of the strict patterns."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    octets = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
        F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(999)) <= 255))
    return F.when(kind == 0, True).when(kind == 1, octets).when(
        kind == 2, F.length(digits).between(16, 19) & _luhn(digits)).otherwise(F.length(digits).between(8, 15))


def _by_kind(kind: Column, options: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, options[name]).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(s: Column) -> dict[str, Column]:
    """What the labelers and the shape say about a candidate."""
    match, before = s["match"], F.lower(s["before"])
    digits = F.regexp_replace(match, "[^0-9]", "")
    gazetteer = {
        "email": _vote(F.lower(match).rlike(rf"(?:\.|dot.?\s?)(?:{'|'.join(DOMAINS)})$"), match.rlike(r"\.[0-9]+$")),
        "ip": _vote(~match.rlike(f"^(?:{RESERVED})"), match.rlike(f"^(?:{RESERVED})")),
        "card": _vote(digits.rlike(f"^(?:{ISSUERS})"), digits.rlike("^0")),
        "phone": _vote(match.rlike(rf"^\+?(?:{'|'.join(CALLING)})[ .(-]") | match.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]"), digits.rlike("^0000|^1234"))}
    good = passes(s["kind"], match)
    return {
        "pattern": F.when(s["strict"], F.when(good, 1).otherwise(-1)).otherwise(
            F.when(s["kind"] == 2, F.when(_luhn(digits), 1).otherwise(-1)).otherwise(0)),
        "gazetteer": _by_kind(s["kind"], gazetteer),
        "context": _by_kind(s["kind"], {k: _vote(before.rlike(FOR[k]), before.rlike(AGAINST[k])) for k in KINDS}),
        "size": F.least(F.floor(F.length(match) / 5), F.lit(6)).cast("int"),
        "edge": s["before"].rlike(r"[\p{L}0-9_=]$").cast("int") + 2 * s["after"].rlike(r"^[\p{L}0-9_]").cast("int")}


def candidates(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``spans``: every candidate of a text with its votes; ``base`` marks strict spans that pass."""
    text = whole(field(text_col))
    lists = [_found(F.col("__t"), KINDS.index(kind), strict, probe, pattern) for kind, strict, probe, pattern in PATTERNS]
    found = docs.select(*map(field, carry), text.alias("__t")).select(
        *map(field, carry), F.when(F.rlike("__t", F.lit("[0-9@]|(?i)[\\[( ]at[\\]) ]")), F.concat(*lists)).alias("__s"))
    told = F.transform("__s", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        (s["strict"] & passes(s["kind"], s["match"])).alias("base"), *(v.alias(k) for k, v in _votes(s).items())))
    return found.select(*map(field, carry), told.alias("spans"))


@dataclass
class SpanModel:
    """Log odds of each kind and of each of its feature values; how often each labeler votes rightly."""

    odds: dict[str, float]
    trust: dict[tuple[str, str], float]


def fit_spans(counts: list[tuple[int, dict[str, int], int]]) -> SpanModel:
    """EM over (kind, features, number) rows; the labelers are the first three features."""
    odds: dict[str, float] = {}
    trust: dict[tuple[str, str], float] = {}
    labelers = FEATURES[:3]
    for k, name in enumerate(KINDS):
        rows = [(f, n) for kind, f, n in counts if kind == k]
        if not rows:
            continue
        posterior = [1 / (1 + math.exp(-1.5 * sum(f[x] for x in labelers))) for f, _ in rows]

        def table(x: str) -> dict[tuple[int, int], float]:
            held: dict[tuple[int, int], float] = defaultdict(lambda: 1.0)
            for (f, n), p in zip(rows, posterior):
                held[f[x], 1] += n * p
                held[f[x], 0] += n * (1 - p)
            values = {v for v, _ in held}
            sums = {y: sum(held[v, y] for v in values) for y in (0, 1)}
            return {(v, y): held[v, y] / sums[y] for v in values for y in (0, 1)}

        for _ in range(ROUNDS):
            yes = sum(n * p for (_, n), p in zip(rows, posterior)) + 1
            no = sum(n * (1 - p) for (_, n), p in zip(rows, posterior)) + 1
            seen = {x: table(x) for x in labelers}
            posterior = [1 / (1 + math.exp(-max(-30, min(30, math.log(yes / no) + sum(
                math.log(seen[x][f[x], 1] / seen[x][f[x], 0]) for x in labelers))))) for f, _ in rows]
        yes = sum(n * p for (_, n), p in zip(rows, posterior)) + 1
        no = sum(n * (1 - p) for (_, n), p in zip(rows, posterior)) + 1
        odds[f"{k}"] = math.log(yes / no)
        for x in FEATURES:
            seen_x = table(x)
            for v in {v for v, _ in seen_x}:
                odds[f"{k}|{x}|{v}"] = math.log(seen_x[v, 1] / seen_x[v, 0])
            if x in labelers:
                right = sum(n * (p if f[x] > 0 else 1 - p) for (f, n), p in zip(rows, posterior) if f[x])
                trust[name, x] = (right + 1) / (sum(n for f, n in rows if f[x]) + 2)
    return SpanModel(odds, trust)


def learn_spans(found: DataFrame) -> SpanModel:
    """The model of all candidates; only counts of kind and feature values reach the driver, at most a few thousand rows."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *(f"s.{x}" for x in FEATURES)).count().collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    return fit_spans([(r["kind"], {x: r[x] for x in FEATURES}, r["count"]) for r in rows])


def _likely(s: Column, model: SpanModel) -> Column:
    if not model.odds:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for kv in sorted(model.odds.items()) for x in kv])
    score = F.coalesce(F.element_at(table, s["kind"].cast("string")), F.lit(0.0))
    for x in FEATURES:
        score = score + F.coalesce(F.element_at(table, F.concat_ws("|", s["kind"].cast("string"), F.lit(x), s[x].cast("string"))), F.lit(0.0))
    return score >= 0


def personal_spans(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, SpanModel]:
    """(``carry`` columns with base and spans, the model): arrays of (kind number, start, end), ordered; ends are exclusive.

    base are the matches of the strict patterns that pass their checks; spans adds candidates that the classifier accepts, that
    failed no check and that no base span of their kind overlaps. Null and empty texts have none; repeated rows get equal spans; columns of ``docs``
    named like a result are replaced; an empty table gives no rows and a model without odds.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("base", "spans")]
    found = durable(candidates(docs, text_col, carry))
    model = learn_spans(found)

    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    return found.select(*map(field, carry), _narrow(F.filter(spans, lambda s: s["base"])).alias("base"),
                        let(F.array_sort(spans), lambda v: _narrow(_accepted(v, model))).alias("spans")), model


def _narrow(spans: Column) -> Column:
    """(kind, start, end) of each span, ordered, none twice."""
    told = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return let(told, lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))))


def _accepted(spans: Column, model: SpanModel) -> Column:
    """Of spans ordered by kind and start the base ones and the likely ones that no base span of their kind overlaps.

    A base span overlaps if one that starts earlier ends behind the start, or one that starts later starts before the end.
    """
    lines = F.lit(1 << 40)  # each kind has a number line of its own
    on = lambda s, end: s["kind"].cast("bigint") * lines + s[end]
    never = F.lit((1 << 62) - 1)
    ends = before_each(F.transform(spans, lambda s: F.when(s["base"], on(s, "end")).otherwise(F.lit(0).cast("bigint"))), F.lit(0), F.greatest)
    starts = F.reverse(before_each(F.transform(F.reverse(spans), lambda s: F.when(s["base"], on(s, "start")).otherwise(never)), never, F.least))

    def picked(end: Column, start: Column) -> Column:
        return F.filter(spans, lambda s, i: s["base"] | ((s["pattern"] >= 0) & (F.get(end, i) <= on(s, "start")) & (
            F.get(start, i) >= on(s, "end")) & _likely(s, model)))

    return let(ends, lambda e: let(starts, lambda st: picked(e, st)))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = personal_spans(docs, carry=["doc_id"])
    return found.select("doc_id", *(_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
