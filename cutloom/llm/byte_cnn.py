"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole document, each chunk keeps the largest answer of every filter, and the
largest and the mean answer over the chunks give one probability. Filters at a chunk's end read on into the next chunk, so that
chunks overlap and every byte of the document is seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .columns import field, with_fields
from .labelled import held_out, training_sample

SAMPLE_ROWS = 2500  # labelled rows that the network is fitted on
EMBED, STRIDE, TAPS, FILTERS = 8, 4, 3, 32  # a filter spans TAPS * STRIDE bytes
CHUNK = 256  # filter positions of a chunk: 1024 bytes
TRAIN_CHUNKS = 6  # chunks of a document drawn in one training step
EPOCHS, BATCH, RATE = 8, 64, 0.004
BLOCK = 1 << 17  # filter positions computed at once
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (TAPS, STRIDE * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    mix: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        return Network(f32(r.normal(0, 0.5, (256, EMBED))),
                       f32(r.normal(0, (2 / (TAPS * STRIDE * EMBED)) ** 0.5, (TAPS, STRIDE * EMBED, FILTERS))),
                       np.zeros(FILTERS, np.float32), f32(r.normal(0, 0.1, 2 * FILTERS)), np.zeros(1, np.float32))


def steps_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of STRIDE bytes, filter positions of each text): texts one after the other, zeros after each so that none overlap."""
    raw, off = words.bytes_of(texts)
    size = np.diff(off)
    many = np.maximum(1, -(-size // STRIDE))
    first = np.cumsum(many + TAPS - 1) - (many + TAPS - 1)
    out = np.zeros(int((many + TAPS - 1).sum()) * STRIDE, np.uint8)
    out[np.repeat(first * STRIDE - off[:-1], size) + np.arange(len(raw))] = raw
    return out.reshape(-1, STRIDE), many


def answers(net: Network, rows: np.ndarray) -> np.ndarray:
    """Filter answers at each position of ``rows`` that has TAPS rows."""
    x = net.embed[rows].reshape(len(rows), -1)
    n = len(rows) - TAPS + 1
    out = x[:n] @ net.filters[0]
    for k in range(1, TAPS):
        out += x[k:k + n] @ net.filters[k]
    return out


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The probability of each whole text."""
    if not len(texts):
        return np.zeros(0)
    rows, many = steps_of(texts)
    first = np.cumsum(many + TAPS - 1) - (many + TAPS - 1)
    chunks = -(-many // CHUNK)
    at = np.repeat(first, chunks) + words.ranges(np.zeros(len(many), np.int64), chunks) * CHUNK
    end = np.minimum(at + CHUNK, np.repeat(first + many, chunks))
    top = np.empty((len(at), FILTERS), np.float32)
    start = 0
    while start < len(at):  # whole chunks, about BLOCK positions at once
        stop = max(start + 1, int(np.searchsorted(end, at[start] + BLOCK, "right")))
        got = answers(net, rows[at[start]:end[stop - 1] + TAPS - 1])
        cuts = np.stack([at[start:stop], end[start:stop]], 1).ravel() - at[start]
        top[start:stop] = np.maximum.reduceat(got, np.minimum(cuts, len(got) - 1), axis=0)[::2]
        last = got[cuts[-2]:cuts[-1]].max(0)  # its end is the end of the block
        top[stop - 1] = last
        start = stop
    top = np.maximum(top + net.bias, 0)
    begin = np.cumsum(chunks) - chunks
    pooled = np.concatenate([np.maximum.reduceat(top, begin, axis=0), np.add.reduceat(top, begin, axis=0) / chunks[:, None]], 1)
    out = 1 / (1 + np.exp(-np.clip((pooled @ net.mix + net.shift).astype(np.float64), -30, 30)))
    return np.round(out, 6)  # sums may differ in the last bits with what else is in the block


def _gradients(net: Network, rows: np.ndarray, at: np.ndarray, doc: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the log loss, for chunks at ``at`` (CHUNK positions each) of the documents ``doc``."""
    windows = rows[at[:, None] + np.arange(CHUNK + TAPS - 1)]
    x = net.embed[windows].reshape(len(at), CHUNK + TAPS - 1, -1)
    got = sum(x[:, k:k + CHUNK] @ net.filters[k] for k in range(TAPS))
    where = got.argmax(1)
    top = np.take_along_axis(got, where[:, None], 1)[:, 0] + net.bias
    live = top > 0
    top = np.maximum(top, 0)
    n = len(y)
    count = np.bincount(doc, minlength=n).astype(np.float32)
    best = np.zeros((n, FILTERS), np.float32)
    np.maximum.at(best, doc, top)
    mean = np.zeros((n, FILTERS), np.float32)
    np.add.at(mean, doc, top)
    mean /= count[:, None]
    pooled = np.concatenate([best, mean], 1)
    error = ((1 / (1 + np.exp(-np.clip(pooled @ net.mix + net.shift, -30, 30))) - y) / n).astype(np.float32)
    back = error[:, None] * net.mix
    lead = (top == best[doc]) & live
    g = back[doc, :FILTERS] * lead + back[doc, FILTERS:] / count[doc, None] * live
    c, f = np.nonzero(g)
    gs, spot = g[c, f], where[c, f]
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for k in range(TAPS):
        seen = x[c, spot + k]
        for j in range(FILTERS):
            mine = f == j
            d_filters[k, :, j] = gs[mine] @ seen[mine]
        d_x = gs[:, None] * net.filters[k][:, f].T
        np.add.at(d_embed, windows[c, spot + k].ravel(), d_x.reshape(-1, EMBED))
    return [d_embed, d_filters, g.sum(0), pooled.T @ error, error.sum(keepdims=True)]


def fit_network(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted by Adam; the prior alone if there are no texts or one class only."""
    net = Network.fresh(seed)
    ones = float(np.sum(y))
    net.shift[:] = np.log((ones + 0.5) / (len(y) - ones + 0.5))
    if not len(y) or not ones or ones == len(y):
        net.mix[:] = 0
        return net
    rows, many = steps_of(words.text_array(pa.array(texts, pa.string())))
    first = np.cumsum(many + TAPS - 1) - (many + TAPS - 1)
    rows = np.concatenate([rows, np.zeros((CHUNK + TAPS, STRIDE), np.uint8)])
    y = y.astype(np.float32)
    r = np.random.default_rng(seed)
    names = [f.name for f in fields(Network)]
    state = [(np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for start in range(0, len(y), BATCH):
            docs = order[start:start + BATCH]
            at, doc = [], []
            for k, d in enumerate(docs):
                chunks = -(-many[d] // CHUNK)
                take = np.arange(chunks) if chunks <= TRAIN_CHUNKS else r.choice(chunks, TRAIN_CHUNKS, replace=False)
                at.append(first[d] + np.maximum(0, np.minimum(take * CHUNK, many[d] - CHUNK)))
                doc.append(np.full(len(take), k))
            grads = _gradients(net, rows, np.concatenate(at), np.concatenate(doc), y[docs])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for name, (m, v), g in zip(names, state, grads):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                getattr(net, name)[...] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def learn_quality(docs: DataFrame, labels: DataFrame, target: str = "quality = 1", rows: int = SAMPLE_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted on the texts of at most ``rows`` labelled rows outside the held-out part; texts are its only input."""
    sample = training_sample(docs, labels, {"target": target}, rows, id_col, text_col)
    return fit_network([r["text"] for r in sample], np.array([r["target"] for r in sample]))


def score_quality(docs: DataFrame, net: Network, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with score, the probability that the whole text is good.

    Null and empty texts are scored as one position of zeros; repeated rows get equal scores; a column named score is replaced.
    An empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.shards(batch, text_col):
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score_texts(net, texts), pa.float64())], names=[*carry, "score"])

    return docs.select(*map(field, dict.fromkeys([*carry, text_col]))).mapInArrow(scan, with_fields(docs, carry, "score double"))


def op6_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net, carry=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
