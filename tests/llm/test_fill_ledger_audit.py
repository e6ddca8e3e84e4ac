"""Fill-in-middle, rule ledger and filter audit: against plain Python on odd and random texts, and what their docstrings define."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutloom.llm import fill_middle, filter_audit, rule_ledger
from cutloom.llm.words import row_of
from tests.llm.conftest import LONG, NAMES, ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(seed, n=200):
    r = random.Random(seed)
    parts = ["a", "bé", "日本", "\n", "\n\n", " ", "\t", "X", "#", "<P", "S>", "word word", "\U0001F600", "<M>", ""]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def cut(doc_id, text, rate=100, spm=50, seed=7):
    """(n, form, prefix, middle, output) by the plain rule."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_scatter_equals_the_plain_cut(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    texts = random_texts(block) + ["", "\n", "a", "a\n", "\na", "<P>", "x" * 50 + "\n" * 9]
    draws = np.array([[int(sha(f"7:{k}")[8 * j:8 * j + 8], 16) for j in range(4)] for k in range(len(texts))])
    for rate, spm in ((100, 50), (60, 0), (0, 50), (100, 100)):
        made = fill_middle.transform(pa.array(texts, pa.large_string()), draws, rate, spm, fill_middle.Marks())
        got = list(zip(*(made[c].to_pylist() for c in fill_middle.RESULTS)))
        assert got == [cut(k, t, rate, spm) for k, t in enumerate(texts)]
        forms = np.array(made["form"].to_pylist(), object)
        assert fill_middle.gathered(made["output"], forms, fill_middle.Marks()).to_pylist() == texts


def test_scatter_of_odd_rows(odd):
    out = fill_middle.fill_in_middle(odd)
    assert out.columns == [*odd.columns, *fill_middle.RESULTS]
    got = Counter((r.doc_id, r.n_lines, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((i, *cut(i, t or "")) for i, t in ODD)
    back = fill_middle.restored(out).collect()
    assert all(r.restored == (r.text or "") for r in back) and len(back) == len(ODD)
    named = odd.withColumns({"FORM": F.lit("own"), "output": F.lit(1), "restored": F.lit(2)})
    assert fill_middle.restored(fill_middle.fill_in_middle(named)).where("form = 'own'").count() == 0
    assert fill_middle.restored(fill_middle.fill_in_middle(odd.limit(0))).count() == 0
    assert fill_middle.fill_in_middle(odd, rate=0).where("form <> 'plain' or output <> coalesce(text, '')").count() == 0


def test_marks():
    own = fill_middle.Marks("[pre]", "[suf]", "[mid]")
    made = fill_middle.transform(pa.array(["a\nb\nc\n<P>"], pa.large_string()), np.array([[1, 3, 0, 99]]), 100, 50, own)
    assert made["output"].to_pylist() == ["[pre]a\n[suf]<P>[mid]b\nc\n"]
    for bad in (("<A>", "<A>", "<B>"), ("aba", "x", "y"), ("ab", "ba", "y"), ("", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*bad)
    with pytest.raises(ValueError):
        fill_middle.gathered(pa.array(["no marks"], pa.large_string()), np.array(["psm"], object), own)


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(k, k + 8))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def test_measurements_and_policies(spark, odd):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)] + random_texts(5, 60)
    texts += ["- one\n* two\n• three", "so on...\nand…", "1 2 3 a", "x " * 30, "a\n a\na\n\n\n"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    told = rule_ledger.ledger(docs, carry=["doc_id", "text"])
    rows = rule_ledger.judged(told).collect()
    assert len(rows) == len(ODD) + len(texts)
    for x in rows:
        want = measures(x.text or "")
        assert {k: x[k] for k in want} == want, x.text
        few = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert x.kept_base == (not few) and x.kept_v1 == (x.failed == 0)
    by_text = {x.text: x for x in rows}
    assert by_text["- one\n* two\n• three"].n_bullet_lines == 3 and by_text["so on...\nand…"].n_open_lines == 2
    assert by_text["1 2 3 a"].n_letter_words == 1 and by_text[LONG].n_repeat_words == 30_000
    clash = odd.withColumn("failed", F.lit("own"))
    assert rule_ledger.ledger(clash, carry=clash.columns).schema["failed"].dataType.simpleString() == "bigint"
    assert set(NAMES) - {"n_words"} < set(rule_ledger.ledger(clash, carry=clash.columns).columns)
    assert rule_ledger.judged(rule_ledger.ledger(odd.limit(0))).count() == 0


def test_a_repeat_in_a_very_long_text(spark):
    words = [f"w{k}" for k in range(200_000)]
    text = " ".join(words + words[1000:1010])
    docs = spark.createDataFrame([(1, text), (2, "\n".join(["same line"] * 100_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in rule_ledger.ledger(docs).collect()}
    assert got[1].n_words == 200_010 and got[1].n_repeat_words == 20
    assert got[2].n_dup_lines == 99_999 and got[2].n_repeat_words == 200_000


def test_ablations_and_agreement(spark):
    rules = [rule_ledger.Rule(k, f"r{k}", f"n_words % {k + 2} = 0") for k in range(3)]
    policies = [rule_ledger.Policy("all", (0, 1, 2)), rule_ledger.Policy("two", (0, 1, 2), allowed=1), rule_ledger.Policy("hard", (0,), strict=(2,))]
    sizes = list(range(1, 61)) * 3
    entries = spark.createDataFrame([(n,) for n in sizes], "n_words long").withColumn("failed", rule_ledger.failed_bits(rules))
    fails = lambda n: {k for k in range(3) if n % (k + 2) == 0}

    def keeps(n, bits, strict, allowed):
        return len(fails(n) & bits) <= allowed and not fails(n) & strict

    want = {}
    for p in policies:
        bits, strict = set(p.bits), set(p.strict)
        for k in bits | strict:
            out = [n for n in sizes if not keeps(n, bits, strict, p.allowed)]
            gained = [n for n in out if keeps(n, bits - {k}, strict - {k}, p.allowed)]
            want[p.version, f"r{k}"] = (len(sizes), len(out), sum(k in fails(n) for n in sizes), len(gained), sum(gained))
    got = {(r.version, r.rule): (r.documents, r.dropped, r.fails, r.kept_without, r.words_without)
           for r in rule_ledger.ablations(entries, policies, rules).collect()}
    assert got == want
    pairs = {(r.rule, r.other): (r.both, r.either) for r in rule_ledger.agreement(entries, rules).collect()}
    assert pairs == {(f"r{a}", f"r{b}"): (sum({a, b} <= fails(n) for n in sizes), sum(bool({a, b} & fails(n)) for n in sizes))
                     for a in range(3) for b in range(a + 1, 3)}
    assert rule_ledger.ablations(entries.limit(0), policies, rules).count() == 0
    with pytest.raises(ValueError):
        rule_ledger.failed_bits([rules[0], rules[0]])


@pytest.mark.parametrize("compared", [3, 1 << 20])
def test_transducer_equals_plain_counts(monkeypatch, compared):
    monkeypatch.setattr(filter_audit, "COMPARED", compared)
    texts = random_texts(9, 150) + ["", "A", " A ", "é", "a a A a", "x" * 100 + " " + "x" * 99 + "y " + "x" * 100, "a b", "b a"]
    got = list(zip(*(c.tolist() for c in filter_audit.counts_of(pa.array(texts, pa.large_string()), filter_audit.classes_of()))))
    for text, counts in zip(texts, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert counts == (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def test_table_tells_words_of_equal_hash_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "_span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["ab cd ab ef cd", "ab ab", "gh ij"]
    got = filter_audit.counts_of(pa.array(texts, pa.large_string()), filter_audit.classes_of())
    assert got[1].tolist() == [3, 1, 2]
    raw = np.frombuffer(b"aabbaa", np.uint8)
    spans = np.array([0, 2, 4])
    assert filter_audit.distinct_spans(raw, spans, spans + 2, row_of(np.array([3]))).sum() == 2


def plain_audit(rows):
    """{(part, order, step): counts} of (id, part, text, good, toxic) rows."""
    ids = {}
    for i, _, t, _, _ in rows:
        ids.setdefault(t, []).append(i)

    def failing(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(x is not None and (i is None or x < i) for x in ids[t])
        return {k for k, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                              bool(re.search(r"[#$%&*|]", t)), smaller)) if bad}

    out = {}
    for part in {r[1] for r in rows}:
        docs = [(failing(i, t), good, toxic) for i, p, t, good, toxic in rows if p == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                gone = lambda f: bool(f & set(order[:step - 1]))  # noqa: E731, B023
                removed = [d for d in docs if own in d[0] and not gone(d[0])]
                total[own] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not f & set(order[:step]) for f, _, _ in docs), len(removed), sum(own in f and gone(f) for f, _, _ in docs),
                    sum(f == {own} for f, _, _ in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def test_audit_equals_the_plain_one(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["Aa", "b", "c$", "d", "E", f"w{r.randrange(99)}"]) for _ in range(r.choice([3, 60, 80]))) for _ in range(40)] + [None, ""]
    docs = [(r.choice([None, *range(60)]), r.choice(["s", "t", None, ""]), r.choice(texts)) for _ in range(150)]
    docs += docs[:10]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 50, 2)] + [(4, 1, 1), (None, 1, 1)]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    frame = spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id long, source string, text string, part string, n_words int").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley]
           for x in filter_audit.filter_audit(frame, table).collect()}
    assert got == plain_audit([(i, p or "", t or "", i in good, i in toxic) for i, p, t in docs])
    assert filter_audit.filter_audit(frame.limit(0), table).count() == 0
    assert filter_audit.filter_audit(frame, table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_other_filters(spark, odd, labels):
    out = filter_audit.filter_audit(odd, labels, filters={"W": "n_words = 0", "X": "n_points > 20"}, copies=None).collect()
    assert len(out) == 4 and {r.filter_order for r in out} == {"WX", "XW"} and {r.part for r in out} == {"s"}
    assert {r.removed for r in out if r.filter_order[r.step - 1] == "W"} == {4}
    long = filter_audit.measured(odd.where("doc_id = 7"), carry=["doc_id"]).first()
    assert (long.n_words, long.n_distinct, long.n_points) == (30_000, 1, len(LONG))
