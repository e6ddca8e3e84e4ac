"""Odd inputs: what each operator's docstring says about nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import numpy as np
import pytest

import corpus_pipeline
from cutloom.llm import (byte_cnn, decontaminate, exact_dedup, jaccard_join, line_runs, page_text, personal_data, pieces, repeats, slots,
                         toxicity)
from cutloom.llm.labelled import training_sample
from tests.llm.conftest import LONG, ODD


def all_rows(df):
    return sorted(df.collect(), key=repr)


def test_toxicity(odd, labels):
    model = toxicity.learn_toxicity(odd, labels)
    out = toxicity.score_toxicity(odd, model)
    assert out.count() == len(ODD) and set(odd.columns) < set(out.columns)
    scores = {r.p_toxic for r in out.where("doc_id in (1, 2, 10)").collect()}
    assert len(scores) == 1
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    bare = toxicity.learn_toxicity(odd, labels.limit(0))
    assert not [r for r in toxicity.score_toxicity(odd, bare).collect() if r.is_toxic]


def test_repeats(spark, odd):
    assert repeats.repeated_passages(odd.limit(0)).count() == 0
    words = [f"w{k}" for k in range(80)]
    two = spark.createDataFrame([(101, "a b " + " ".join(words)), (102, " ".join(words[10:70]) + " tail"), (103, " ".join(words[:49]))], "doc_id long, text string")
    got = all_rows(repeats.repeated_passages(odd.select("doc_id", "text").unionByName(two)))
    assert [(r.id, r.start_word, r.end_word) for r in got] == [(101, 12, 72), (102, 0, 60)]


def test_lines(odd):
    out = line_runs.drop_common_lines(odd, min_documents=2)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) and got[1].kept_text == "" and got[1].n_lines == 1 and got[1].n_dropped == 0
    assert got[5].kept_text == "" and got[5].n_dropped == 2 and got[4].kept_text == "same  text here" and got[7].kept_text == LONG
    assert got[1]["kept"] == "own" and line_runs.drop_common_lines(odd.limit(0)).count() == 0


def test_lines_that_arrive(spark):
    runs = line_runs.LineRuns(spark, fan_in=2)
    batch = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "doc_id long, text string")
    kept = [sorted(r.kept_text for r in line_runs.drop_seen_lines(b, runs).collect())
            for b in (batch("a\nb", "c"), batch(" A \nd"), batch("d\ne"), batch("e\nf\na"))]
    assert kept == [["a\nb", "c"], ["d"], ["e"], ["f"]]
    assert [len(level) for level in runs.levels] == [0, 0, 1]  # four runs of level 0 were merged twice
    assert {r.n for r in runs.counts().collect()} == {1, 2, 3}


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h/a/1", ""), (3, "http://h/a/2", "<p>own<p>frame</p><!-- x"), (4, "http://h/a/3", "<div>other</div><p>frame"),
            (5, "http://h/b", "<nav>m</nav><article><p>x &amp; <b>y</b><br>z<script>var a='</p>'</script><div class='ad'>buy</div><p>last"),
            (6, "http://h/a/3", "<div>other</div><p>frame"), (7, "h", "<div class=ad>never closed <article><h1>T</h1>t</article><footer>f"),
            (8, "u", "plain &lt;text&gt; 1 < 2"), (9, "v", "<a title=\"x>y</a><p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, gone string")
    got = {r.page_id: r.main_text for r in page_text.main_text(pages).collect()}
    assert (got[1], got[2], got[3], got[4], got[6]) == ("", "", "own", "other", "other")
    assert got[5] == "x & y z\n\nlast" and got[7] == "T\n\nt" and got[8] == "plain <text> 1 < 2" and len(got[9]) > 200_000
    assert page_text.main_text(pages.limit(0)).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (r.integers(0, 4, r.integers(0, 12)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        spots, at = page_text.common_lines(a, b), -1
        assert len(spots) == table[-1, -1] and spots == sorted(spots)
        for k in spots:
            at = b.index(a[k], at + 1)


def test_personal_data(odd):
    out, model = personal_data.personal_spans(odd)
    assert out.count() == len(ODD) and all(r.base == [] and r.spans == [] for r in out.collect()) and out.first()["kept"] == "own"
    none, bare = personal_data.personal_spans(odd.limit(0))
    assert none.count() == 0 and bare.odds == {}


def test_quality(odd, labels):
    net = byte_cnn.learn_quality(odd, labels)
    out = byte_cnn.score_quality(odd, net)
    assert out.count() == len(ODD) and all(0 <= r.score <= 1 for r in out.collect()) and out.columns.count("score") == 1
    assert len({r.score for r in out.where("doc_id in (1, 2, 10)").collect()}) == 1
    assert byte_cnn.score_quality(odd.limit(0), net).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_part(odd, labels):
    got = training_sample(odd, labels, {"t": "toxic = 1"}, 1)
    assert len(got) == 1 and all(r["id"] in (4, 7, 9) for r in got)


def test_similar(odd):
    got = {r.id: r for r in jaccard_join.similar_classes(odd).collect()}
    assert [(got[k].n_shingles, got[k].component_id) for k in (1, 2, 3, 4, 5, 9)] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 4), (1, 9)]
    assert jaccard_join.similar_classes(odd.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id is null").count() == 1


def test_exact(odd):
    got = all_rows(exact_dedup.exact_groups(odd).select("doc_id", "keep_id", "group_size", "kept"))
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[2].keep_id, by[1].group_size, by[1].kept, by[10].kept) == (1, 3, True, False)
    assert (by[5].keep_id, by[5].group_size, by[4].kept, by[3].keep_id) == (4, 3, True, 3)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9]
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_pieces(odd, rate):
    v = pieces.load_vocabulary()
    out = pieces.encode_and_check(odd, v, rate=rate)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[1] == 0
    assert "size" in pieces.encode_pieces(odd, v).columns and pieces.encode_pieces(odd.limit(0), v).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(odd, v, rate=rate, out="ids"), v, "ids")
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_passages(spark, odd):
    bench = spark.createDataFrame([(1, "Same text"), (2, None), (3, ""), (None, "one"), (5, "x " * 12), (5, "x " * 12)], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([(20, "a same TEXT b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"), True)
    got = {r.doc_id: r for r in decontaminate.find_passages(docs, bench).collect()}
    assert (got[20].n_words, got[20].n_hit, got[20]["items"], got[20].longest_start) == (4, 2, ["1"], 1)
    assert got[1].n_words == 0 and got[9].n_hit == 0 and got[4]["items"] == ["1"] and got[7].n_hit == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.find_passages(odd.limit(0), bench).count() == 0 and decontaminate.find_passages(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_passages_in_blocks(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "items", "longest_words", "longest_start", "longest_item"]
    whole = decontaminate.find_passages(docs, bench).select(*cols)
    parts = decontaminate.find_passages(docs, bench, block_chars=2000).select(*cols)
    assert all_rows(whole) == all_rows(parts)


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path, labels):
    labels.where("coalesce(toxic, 0) = 0").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "same text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where("not lossless").count() == 0
    got = {r.doc_id for r in docs.collect()}
    assert {1, 3, 8, 9} <= got and not {2, 4, 5, 10} & got




def test_repeats_of_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, "x y " + " ".join(words)), (1, " ".join(words)), (None, "z " + " ".join(words[:55])), (None, " ".join(f"u{k}" for k in range(70))),
            (None, " ".join(f"u{k}" for k in range(70)))]
    got = all_rows(repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r.id, r.start_word, r.end_word, r.other) for r in got} == {(1, 0, 60, None), (None, 2, 62, 1), (None, 1, 56, 1)} or {
        (r.id, r.other) for r in got} == {(1, None), (None, 1)}
    assert all_rows(repeats.repeated_passages(spark.createDataFrame(rows[3:], "doc_id long, text string"))) == []
    named = spark.createDataFrame([(None, rows[0][1]), ("a", rows[1][1])], "doc_id string, text string")
    assert {(r.id, r.other) for r in repeats.repeated_passages(named).collect()} == {("a", None), (None, "a")}


def test_similar_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(100)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (0, 50, 99)]
    text = " ".join(words)
    for rows, want in (([(None, near[0]), (None, near[2]), (1, text)], {(None, 1), (1, 1)}), ([(None, near[0]), (5, near[2])], {(None, 5), (5, 5)}),
                       ([(None, near[0]), (None, near[2]), (None, near[0])], {(None, None)}), ([(None, "a b"), (2, "c d")], {(None, None), (2, 2)})):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = jaccard_join.similar_classes(df, percent=80).collect()
        assert len(got) == len(rows) and {(r.id, r.component_id) for r in got} == want
    kept = jaccard_join.one_of_each(spark.createDataFrame([(None, near[0]), (5, near[2]), (6, text)], "doc_id long, text string"), percent=80).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 5]


def test_keys_beyond_the_largest_table(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (3, "c")], "k long, s string")
    keys = rows.where("k is null or k = 2").unionByName(rows.where("k = 2"))
    told = slots.likely_held(rows, keys, ["k", "s"]).collect()
    monkeypatch.setattr(slots, "MOST_WORDS", 1)
    exact = slots.likely_held(rows, keys, ["k", "s"]).collect()
    assert {(r.k, r.s) for r in exact} == {(None, "b"), (2, None)} <= {(r.k, r.s) for r in told} and len(exact) == 2
    assert slots.fitting_words(10 ** 9) is None and slots.likely_held(rows, keys.limit(0), ["k"]).count() == 0
