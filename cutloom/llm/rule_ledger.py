"""Quality rules by a bitmask ledger: each rule is evaluated once per document, policies and ablations read only the ledger.

A measurement is a column expression over the text, a rule a condition over measurements with a bit of its own. The ledger holds
the measurements and one integer whose set bits are the failed rules. A policy is a version, the bits that it looks at and how many of
them a document may fail; changing a policy reads no text again. Ablations count documents per distinct integer first, so that what
is compared with every rule of every policy is at most one row per combination of rules, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import SPACES, field, fresh, let, whole

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANK = "[ \\t\\n\\x0B\\f\\r]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_bullet_lines", "n_open_lines")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over measurements; null counts as not failed. ``bit`` is never used for another rule again."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document fails if more than ``allowed`` of the rules with these bits fail, or any of the ``strict`` ones."""

    version: str
    bits: tuple[int, ...]
    strict: tuple[int, ...] = ()
    allowed: int = 0

    @staticmethod
    def mask(bits: Sequence[int]) -> int:
        return sum(1 << b for b in set(bits))


RULES = (
    Rule(0, "few words", "n_words < 20"),
    Rule(1, "repeated words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "short words", "word_chars < 3 * n_words"),
    Rule(3, "long words", "word_chars > 10 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "words without a letter", "10 * n_letter_words < 8 * n_words"),
    Rule(7, "bullets", "10 * n_bullet_lines > 9 * n_lines"),
    Rule(8, "open ends", "10 * n_open_lines > 3 * n_lines"),
)
BASE = (0, 1)
POLICIES = (Policy("base", BASE), Policy("v1", tuple(r.bit for r in RULES), strict=BASE))


def _repeated(words: Column, width: int) -> Column:
    """Words that lie in a run of ``width`` words found twice or more.

    Windows are compared by a 64-bit hash of the words' 64-bit hashes. Only texts with an equal pair sort their windows; the
    ones with an equal neighbour are walked in order of place, so the work is that of a sort.
    """
    def windows(h: Column) -> Column:
        last = F.size(h) - width + 1
        return F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(h, i, width)))).otherwise(
            F.array().cast("array<bigint>"))

    def places(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda o: F.sort_array(F.transform(F.filter(o, lambda p, k: (  # an equal one before or behind it
            F.get(o, k - 1)["x"] == p["x"]) | (F.get(o, k + 1)["x"] == p["x"])), lambda p: p["i"])))

    def covered(at: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, first, lambda a, i: F.struct(
            (a["n"] + i + width - F.greatest(i, a["end"])).cast("bigint").alias("n"), (i + width).alias("end")), lambda a: a["n"])

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(places(w))).otherwise(F.lit(0).cast("bigint"))))


def measured(text: Column) -> Column:
    """A struct of all measurements of a text; words are runs of characters other than ASCII white space."""
    without = F.translate(text, SPACES, "")
    words = F.filter(F.split(text, BLANK, -1), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def number(c: Column) -> Column:
        return c.cast("bigint")

    def told(w: Column, ls: Column) -> Column:
        bare = lambda x: F.btrim(x, F.lit(SPACES))
        return F.struct(
            number(F.size(w)).alias("n_words"), number(F.length(without)).alias("word_chars"),
            number(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
            number(F.size(ls)).alias("n_lines"), number(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            _repeated(w, WINDOW).alias("n_repeat_words"), number(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))).alias("n_letter_words"),
            number(F.size(F.filter(ls, lambda x: bare(x).rlike("^[*•\\-]")))).alias("n_bullet_lines"),
            number(F.size(F.filter(ls, lambda x: bare(x).rlike("(?:\\.\\.\\.|…)$")))).alias("n_open_lines"))

    return let(words, lambda w: let(lines, lambda ls: told(w, ls)))


def failed_bits(rules: Sequence[Rule]) -> Column:
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own between 0 and 62")
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ``carry`` columns of each row of ``docs``, its measurements and ``failed``, written once.

    Null texts count as empty: no words, lines or symbols. Repeated rows get equal entries. A carried column named like a measurement or
    ``failed`` is replaced. An empty table gives an empty ledger.
    """
    keep = [c for c in carry if c.lower() not in {*MEASURES, "failed"}]
    text, told = fresh(docs, "text", "told")
    seen = docs.select(*map(field, keep), whole(field(text_col)).alias(text)).select(*map(field, keep), measured(field(text)).alias(told))
    flat = seen.select(*map(field, keep), *(F.col(f"{told}.{m}").alias(m) for m in MEASURES))
    return durable(flat.withColumn("failed", failed_bits(rules)))


def verdict(failed: Column, policy: Policy) -> Column:
    """Whether the policy keeps a document with these failed bits."""
    counted = F.bit_count(failed.bitwiseAND(F.lit(Policy.mask(policy.bits)))) <= policy.allowed
    return counted & (failed.bitwiseAND(F.lit(Policy.mask(policy.strict))) == 0)


def judged(entries: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The ledger with a boolean column ``kept_<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.version}": verdict(F.col("failed"), p) for p in policies})


def ablations(entries: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(version, rule, documents, dropped, fails, kept_without, words_without): what each policy drops, and would keep without a rule.

    kept_without and words_without count documents, and their words, that stay if the rule is left out but not with it. Rules that a
    policy does not look at are not listed; a policy and rule without a document has no row, nor has an empty ledger.
    """
    seen = entries.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    pairs = []
    for p in policies:
        for r in rules:
            if r.bit in p.bits or r.bit in p.strict:
                less = Policy(p.version, tuple(b for b in p.bits if b != r.bit), tuple(b for b in p.strict if b != r.bit), p.allowed)
                gained = ~verdict(F.col("failed"), p) & verdict(F.col("failed"), less)
                pairs.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), (~verdict(F.col("failed"), p)).alias("out"),
                                      (F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0).alias("fails"), gained.alias("gained")))
    each = seen.select("n", "w", F.explode(F.array(*pairs)).alias("p")).select("n", "w", "p.*")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("documents"), count("out").alias("dropped"), count("fails").alias("fails"), count("gained").alias("kept_without"),
        F.sum(F.when(F.col("gained"), F.col("w")).otherwise(0)).alias("words_without"))


def agreement(entries: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, other, both, either): documents that fail two rules, and at least one of them, for each pair of rules that meet."""
    seen = entries.where("failed <> 0").groupBy("failed").agg(F.count("*").alias("n"))
    has = lambda r: F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0
    pairs = [F.struct(F.lit(a.name).alias("rule"), F.lit(b.name).alias("other"), (has(a) & has(b)).alias("both"), (has(a) | has(b)).alias("either"))
             for k, a in enumerate(rules) for b in rules[k + 1:]]
    each = seen.select("n", F.explode(F.array(*pairs)).alias("p")).select("n", "p.*")
    return each.groupBy("rule", "other").agg(F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)).alias("both"),
                                             F.sum(F.when(F.col("either"), F.col("n")).otherwise(0)).alias("either")).where("both > 0")


def op12_rule_ledger(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = judged(ledger(docs))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("kept_base")).alias("base_failed"),
                       F.col("kept_v1").alias("kept"), F.col("failed").alias("failed_rules"))


OP12_SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
b as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select r, i, list_slice(w, i, i + 7) as g from b, unnest(range(1, len(w) - 6)) as u(i)),
h as (select r, i, count(*) over (partition by r, g) as c from g),
q as (select r, count(distinct j) as n from h, unnest(range(i, i + 8)) as u(j) where c > 1 group by r),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l) as n_lines,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(q.n, 0)::bigint as n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as n_letter_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[*•\-]'))) as n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_open_lines
      from b left join q using (r)),
f as (select *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, word_chars < 3 * n_words, word_chars > 10 * n_words, 10 * n_symbols > n_words,
                 10 * n_dup_lines > 3 * n_lines, 10 * n_letter_words < 8 * n_words, 10 * n_bullet_lines > 9 * n_lines,
                 10 * n_open_lines > 3 * n_lines] as fails from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] or fails[2] as base_failed,
       not list_contains(fails, true) as kept,
       list_sum(list_transform(range(1, 10), lambda i: case when fails[i] then 1 << (i - 1)::int else 0 end))::bigint as failed_rules
from f
"""
