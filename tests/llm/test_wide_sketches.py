"""Pairs of large sets that are told apart before their texts are moved."""

from pyspark.sql import functions as F

from cutloom.llm import jaccard_join


def test_large_sets_are_told_apart_without_their_texts(spark):
    """Sketches of one size rule out no pair of large sets, so whole texts went to every pair that shared a key."""
    def text(first, n, off=0):
        return " ".join(f"w{k}" for k in range(first, first + n - off)) + "".join(f" x{k}" for k in range(off))

    texts = [text(0, 4000), text(0, 4000, 300), text(0, 4000, 600), text(3500, 4000), text(9000, 2000), text(9000, 1900), text(20000, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = jaccard_join._prints(docs, "text", 5, "doc_id").select("size", "sketch", "wide", F.col("id").alias("node"))
    pairs = spark.createDataFrame([(i, j) for i in range(7) for j in range(i + 1, 7)], "x long, y long")
    near = jaccard_join._possible(pairs.withColumn("n", F.lit(1).cast("long")), prints, 80).select("x", "y")
    left = {(r.x, r.y) for r in jaccard_join._clear(near, prints, 80).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    like = {(i, j) for i in range(7) for j in range(i + 1, 7) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(0, 1), (4, 5)} <= like <= left and not {(0, 3), (1, 3), (2, 3)} & left
    assert {(0, 3), (1, 3), (2, 3)} <= {(r.x, r.y) for r in near.collect()}
