"""Each query against DuckDB, a brute-force version, an exact round trip or held-out labels."""

import hashlib
import html as entities
import random
import re
import time

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cutloom.llm import byte_cnn, jaccard_join, page_text, personal_data, pieces, repeats, toxicity
from cutloom.llm.columns import before_each
from cutloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.compare import compare


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, folder, name):
    assert compare(spark, name, folder).startswith("ok")


def test_all_thirteen_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_repeats(spark, folder):
    texts, got = texts_of(spark, folder), {}
    for r in QUERIES["op2_sparse_suffixes"](spark, folder).collect():
        assert r.n_words == r.end_word - r.start_word >= repeats.LEAST and r.other_doc_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute.repeated_words(texts, repeats.LEAST)


def test_repeats_of_a_hot_passage_over_many_partitions(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10 ** 6)}"
    passage = [word() for _ in range(60)]
    texts = {k: " ".join([word() for _ in range(r.randrange(40))] + (passage if k % 3 else []) + [word() for _ in range(r.randrange(40))]) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {}
    for x in repeats.repeated_passages(docs).collect():
        got.setdefault(x.id, set()).update(range(x.start_word, x.end_word))
    assert got == brute.repeated_words(texts, repeats.LEAST)


def test_repeats_that_end_in_a_hot_sentence(spark):
    """Two documents share a passage whose last or first words many others hold, so that they are no neighbours in sorted order."""
    for seed, before, after in ((5, 12, 0), (6, 0, 12), (7, 6, 6)):
        r = random.Random(seed)
        word = lambda: f"w{r.randrange(10 ** 6)}"
        some = lambda n: [word() for _ in range(n)]
        sentence = some(40)
        texts = {k: some(30) + sentence + some(30) for k in range(200)}
        for pair in range(30):
            passage = some(before) + sentence + some(after)
            texts |= {1000 + 10 * pair + k: some(30) + passage + some(30) for k in range(2)}
        texts = {k: " ".join(t) for k, t in texts.items()}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {}
        for x in repeats.repeated_passages(docs).collect():
            assert x.other // 10 == x.id // 10 and x.other != x.id
            got.setdefault(x.id, set()).update(range(x.start_word, x.end_word))
        want = brute.repeated_words(texts, repeats.LEAST)
        assert len(want) == 60 and got == want


def test_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op4_page_differencing"](spark, folder).collect()}
    for p in pages:
        body = p.html[p.html.index("<article>") + 9:].split("</article>")[0]
        blocks = (" ".join(entities.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_differencing_of_unmarked_pages(spark):
    frame = lambda k, body: f"<div>Our site</div><div>Buy now</div>{body}<div>All rights reserved</div>"
    rows = [(k, f"http://h.example/{'ab'[k % 2]}/{k:03d}", frame(k, f"<p>text {k} one</p><p>text {k} two</p>")) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.main_text for r in page_text.main_text(pages).collect()}
    assert got == {k: f"text {k} one\n\ntext {k} two" for k in range(40)}


def test_differencing_of_pages_that_differ_in_the_query(spark):
    frame = lambda body: f"<div>Our site</div><div>Buy now</div>{body}<div>All rights reserved</div>"
    want = {k: f"text {k}" for k in range(40)} | {100 + k: "text 7" for k in range(30)} | {200: "one", 201: "two", 300: "in", 301: "left", 302: "right"}
    url = lambda k: "http://one.example/same" if k in (200, 201) else f"http://h.example/index.php?id={k if k < 100 else 7:03d}"
    rows = [(k, url(k), frame(f"<p>{t}</p>")) for k, t in want.items() if k < 300]  # 100 to 129 are copies of 7
    rows += [(300, "http://m.example/b", "<article><p>in</p></article>"), (301, "http://m.example/a", frame("<p>left</p>")),
             (302, "http://m.example/c", frame("<p>right</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.main_text for r in page_text.main_text(pages).collect()} == want


def test_marked_pages_are_differenced_too(spark, folder):
    page = lambda k: f"<nav>Home</nav><div>Our site</div><article><h1>Title {k}</h1><p>Shared line</p></article><footer>Page {k}</footer>"
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", page(k)) for k in range(20)], "page_id long, url string, html string")
    got = {r.page_id: (r.main_text, r.n_shared, r.n_restored) for r in page_text.main_text(pages).collect()}
    assert got == {k: (f"Title {k}\n\nShared line", 3, 1) for k in range(20)}
    given = QUERIES["op4_page_differencing"](spark, folder)
    assert given.where("n_shared > 0").count() > 0


def test_articles_keep_what_names_like_a_menu():
    page = """<div class="nav-bar">menu</div><article class="post"><header class="post-header"><h1 class="banner">Title</h1></header>
      <section id="social-history"><h2 id="related-work" class="related">Work</h2><p>One <span id="Search_methods">way</span>.</p></section>
      <figure class="widget"><img src="a.png"><figcaption class="share">Caption</figcaption></figure>
      <p>As <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>a = 2 in TeX</annotation></semantics></math> says</p>
      <p data-role="share" class="ad-hoc comment-free">Hoc</p><div class="box share">Tell</div><span class=ad>Buy</span><div role="search">Find</div>
      <nav>Next</nav><aside>See</aside><footer>End</footer></article><div id="site-footer">foot</div>"""
    want = ["Title", "Work", "One way.", "Caption", "As a=2 says", "Hoc"]
    assert [t for t, inside in page_text.blocks_of(page) if inside] == want and all(inside for _, inside in page_text.blocks_of(page))


def test_personal_data(spark, folder):
    texts = texts_of(spark, folder)
    more = {-1: "mail a@b.c@d.e.f x_y@q.r a@b.cx_y@d.e 1.2.3.4.5.6.7.8.9 001.002.3.255 1.2.3.256 +1 (2) 345-678-9\x01 4111-1111 1111 1111 é 4111  1111 \U0001F600 a.@b.c",
            -2: "1 2 3 4 5 6 7 8 9 0 " * 3000 + "a." * 20000 + "@b" + ".c" * 20000}
    docs = spark.createDataFrame(list((texts | more).items()), "doc_id long, text string")
    found, model = personal_data.personal_spans(docs)
    for r in found.select("doc_id", personal_data._listed(F.col("base")).alias("base"), personal_data._listed(F.col("spans")).alias("spans")).collect():
        want = brute.base_spans((texts | more)[r.doc_id])
        assert r.base == ",".join(want) and set(want) <= set(filter(None, r.spans.split(",")))
    assert model.trust["email", "pattern"] > 0.5


def test_personal_data_columns():
    """Every column of the query on a larger table; counts of a kind are never places of a span."""
    from tests.harness import session
    spark, folder = session(), "/root/testdata/sf0.01"
    texts, wrong = texts_of(spark, folder), []
    for r in QUERIES["op5_weak_supervision"](spark, folder).collect():
        want = brute.base_spans(texts[r.doc_id])
        counts = [sum(x.startswith(f"{k}:") for x in want) for k, _ in brute.BASE]
        if [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] != [*counts, hashlib.sha256(",".join(want).encode()).hexdigest()]:
            wrong.append(r.doc_id)
        assert set(want) <= set(filter(None, r.spans.split(",")))
    assert not wrong


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"user{k}@host{k % 7}.example.com call 212-555-{k % 10000:04d}" for k in range(100_000))
    start = time.time()
    r = personal_data.personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    want = [(0, m.start(), m.end()) for m in re.finditer(brute.BASE[0][1], text)]
    assert [tuple(x) for x in r.base] == want and set(want) <= {tuple(x) for x in r.spans} and len(r.spans) == len({tuple(x) for x in r.spans})
    assert time.time() - start < 90


def test_accepted_spans_overlap_no_base_span(spark):
    r = random.Random(2)
    texts = [[(r.randrange(3), a, a + r.randrange(1, 9), r.random() < .5, 0, 0, 0, 0, 0) for a in (r.randrange(60) for _ in range(r.randrange(12)))]
             for _ in range(60)]
    names = "kind int, start long, end long, base boolean, pattern int, gazetteer int, context int, size int, edge int"
    df = spark.createDataFrame(list(enumerate(texts)), f"k int, s array<struct<{names.replace(' ', ':').replace(',:', ',')}>>")
    likely = personal_data.SpanModel({"0": 1.0, "1": 1.0, "2": -1.0}, {})
    for row in df.select("k", personal_data._narrow(personal_data._accepted(F.array_sort("s"), likely)).alias("x")).collect():
        rows = texts[row.k]
        base = [x for x in rows if x[3]]
        free = [x for x in rows if not x[3] and x[0] < 2 and not any(b[0] == x[0] and b[1] < x[2] and x[1] < b[2] for b in base)]
        assert [tuple(x) for x in row.x] == sorted({x[:3] for x in base + free})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17, 100])
def test_before_each(spark, n):
    values = [(7 * k * k) % 11 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(before_each(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), before_each(F.col("v"), F.lit(-1), F.greatest).alias("m")).first()
    assert got.s == [sum(values[:k]) for k in range(n)] and got.m == [max([-1, *values[:k]]) for k in range(n)]


def test_looser_patterns_add_spans(spark):
    told = ["call me on 555-123-4567 today", "phone: (212) 555-1234", "card 378282246310005 ok", "contact john at example dot com"] * 30
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(told)], "doc_id long, text string")
    found, _ = personal_data.personal_spans(docs)
    assert found.where("size(base) > 0").count() == 0 and found.where("size(spans) > 0").count() >= 60


def test_similar_classes(spark, folder):
    texts = texts_of(spark, folder)
    got = {r.doc_id: r for r in QUERIES["op7_universe_partition"](spark, folder).collect()}
    want = brute.classes(texts, 4, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(brute.shingles(t, 4)) for i, t in texts.items())


@pytest.mark.parametrize("width, percent", [(2, 85), (5, 80)])
def test_similar_classes_at_the_border(spark, width, percent):
    """Chains of near copies of all sizes, so that many pairs lie on either side of the threshold."""
    r = random.Random(percent)
    texts = {}
    for family in range(40):
        words = [f"f{family}x{r.randrange(10 ** 6)}" for _ in range(r.choice([1, 3, 6, 7, 8, 12, 20, 40, 90, 200]))]
        for _ in range(8):
            words = list(words)
            for _ in range(r.randrange(1 + len(words) // 12)):
                words[r.randrange(len(words))] = f"n{r.randrange(10 ** 9)}"
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.id: x.component_id for x in jaccard_join.similar_classes(docs, width=width, percent=percent).collect()}
    assert got == brute.classes(texts, width, percent)


def test_pieces_equal_the_library_without_dropout(spark, folder):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    v = pieces.load_vocabulary()
    plain = {r.doc_id: r for r in pieces.encode_pieces(docs, v, rate=0.0).collect()}
    assert all(r.pieces == model.encode(r.text or "") for r in plain.values() if "▁" not in (r.text or ""))
    one, two, again = ({r.doc_id: r.pieces for r in pieces.encode_pieces(docs, v, seed=s).collect()} for s in (1, 2, 1))
    assert one == again and one != two
    assert all(model.decode(one[i]) == (r.text or "") for i, r in plain.items() if "▁" not in (r.text or ""))


def test_each_occurrence_of_a_word_is_cut_by_itself():
    import numpy as np
    import pyarrow as pa

    from cutloom.llm import words
    v, drop = pieces.load_vocabulary(), pieces.Dropout(0.1, 1)
    texts = words.text_array(pa.array([" ".join(["international"] * 400)] * 2))
    ids, offsets = pieces.encode_texts(v, texts, np.array([11, 12]), drop)
    cut = []
    for a, b in zip(offsets, offsets[1:]):
        starts = [k for k in range(a, b) if v.pieces[ids[k]].startswith(pieces.SPACE)]
        cut.append([tuple(ids[i:j]) for i, j in zip(starts, [*starts[1:], b])])
    assert all(len(c) == 400 and len(set(c)) > 20 for c in cut) and cut[0] != cut[1]
    plain = max(set(cut[0]), key=cut[0].count)
    assert plain == tuple(pieces.encode_texts(v, words.text_array(pa.array(["international"])), np.zeros(1, int), pieces.Dropout(0, 1))[0])
    # what is not rerun is what its own agenda gives too
    vocabulary = [" international", " of", " understanding"]
    code, key = np.arange(3000) % 3, words.mix(np.arange(3000).astype(np.uint64))
    met = pieces.Candidates()
    ids, off = pieces._encode_words(v, vocabulary, np.arange(3), np.arange(3).astype(np.uint64), met)
    again = set(pieces._skipping(*met.by_word(3), code, key, drop).tolist())
    mine, at = pieces._encode_words(v, vocabulary, code, key, drop)
    assert 0 < len(again) < 3000
    assert all(k in again or np.array_equal(mine[at[k]:at[k + 1]], ids[off[c]:off[c + 1]]) for k, c in enumerate(code))


def test_long_words_give_the_same_by_heap(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cutloom.llm import words
    v, texts = pieces.load_vocabulary(), words.text_array(pa.array(["the thing of interest\nand more", "        x", "aaaaaaaaaaaaaaaaaaaaaab"]))
    side = pieces.encode_texts(v, texts, np.zeros(3, int), pieces.Dropout(0.2, 5))
    monkeypatch.setattr(pieces, "LONG", 0)
    assert all(np.array_equal(a, b) for a, b in zip(side, pieces.encode_texts(v, texts, np.zeros(3, int), pieces.Dropout(0.2, 5))))


def test_held_out_accuracy(spark):
    """Models learn from the rows outside the held-out part of sf0.1 only; its labels of junk texts are partly toxic at random."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    tox = QUERIES["op1_classifier_chain"](spark, folder).join(labels, "doc_id").where("crc32(string(doc_id)) % 5 = 0 and quality = 1")
    hit, said, real, n = tox.agg(F.sum(((F.col("toxic") == 1) & F.col("is_toxic")).cast("int")), F.sum(F.col("is_toxic").cast("int")), F.sum("toxic"), F.count("*")).first()
    assert n > 300 and hit / said > 0.95 and hit / real > 0.95
    q = QUERIES["op6_byte_cnn"](spark, folder).join(labels, "doc_id").where("held_out")
    kept, good, dropped, bad = q.agg(F.sum((F.col("quality") == 1).cast("int") * F.col("predicted")), F.sum("quality"),
                                     F.sum((F.col("quality") == 0).cast("int") * (1 - F.col("predicted"))), F.sum(1 - F.col("quality"))).first()
    assert kept / good > 0.98 and dropped / bad > 0.6


def test_pipeline(spark, folder):
    texts, model = texts_of(spark, folder), None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("is_toxic").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, root in brute.classes(left, 5, 80).items() if i == root}
    windows = brute.windows_of(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())
    left = {i: t for i, t in left.items() if not brute.contaminated(t, windows)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(left) and all(r.lossless for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(library.decode(r.pieces) == left[r.doc_id] for r in got)


def test_network_sees_every_chunk(spark):
    """A text differs from another only behind its 100 000th byte; its score does too."""
    net = byte_cnn.Network.fresh()
    docs = spark.createDataFrame([(1, "abc " * 30_000), (2, "abc " * 29_000 + "%%%% " * 800)], "doc_id long, text string")
    a, b = (r.score for r in byte_cnn.score_quality(docs, net).orderBy("doc_id").collect())
    assert a != b
