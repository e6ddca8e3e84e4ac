"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

While the chain is fitted, those probabilities are predicted out of fold, so a later model never learns from an earlier one's
memory. Inputs are the distinct words of the whole text and their beginnings, matched by 64-bit hash, so that words the sample
never held cannot fall into a learned weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .columns import field, fresh, with_fields
from .labelled import training_sample

SAMPLE_ROWS = 3000  # labelled rows that the chain is fitted on
FEATURES = 2048  # per category, the most telling ones
PARTS = 3
LEAST_TEXTS = 3  # texts of the sample that hold a feature, words of one text by several endings counted
PREFIXES = (4, 5, 6)
LETTERS = words.ALNUM.copy()
LETTERS[ord("0"):ord("9") + 1] = False

#: Categories in chain order, over labels and the documents' language: abuse by language, then abuse in any.
CHAIN = {f"toxic_{lang}": f"toxic = 1 and lang = '{lang}'" for lang in ("de", "en", "es", "fr")} | {"toxic": "toxic = 1"}


def _hashed(values: list[bytes], seed: int) -> np.ndarray:
    text = np.array([v.decode("latin-1") for v in values] or [""], dtype=object)[:len(values)]
    return words.mix(pd.util.hash_array(text, categorize=False) + np.uint64(seed)) if len(values) else np.zeros(0, np.uint64)


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct words of each text: the word and its beginnings, as 64-bit hashes, once per row and word."""
    w = words.Words(texts, LETTERS)
    many = len(w.vocabulary)
    pairs = np.unique(words.row_of(w.counts) * max(many, 1) + w.codes)
    row, code = pairs // max(many, 1), pairs % max(many, 1)
    vocabulary = w.vocabulary.to_pylist()
    rows, marks = [row], [_hashed(vocabulary, 0)[code]]
    for size in PREFIXES:
        long = np.array([len(v) >= size for v in vocabulary], bool)
        take = long[code] if many else np.zeros(0, bool)
        rows.append(row[take])
        marks.append(_hashed([v[:size] for v in vocabulary], size)[code[take]])
    return np.concatenate(rows), np.concatenate(marks)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(row: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 300):
    """Logistic weights (sparse, dense, bias) over the rows in ``use``, on the FEATURES most telling columns."""
    n, ones = use.sum(), y[use].sum()
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    weight, extra = np.zeros(width), np.zeros(dense.shape[1])
    if not n or not ones or ones == n:
        return weight, extra, bias
    mine = use[row]
    row, col = row[mine], col[mine]
    df = np.bincount(col, minlength=width)
    pos = np.bincount(col, weights=y[row], minlength=width)
    p1, p0, p = pos / ones, (df - pos) / (n - ones), df / n
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / ones + 1 / (n - ones)))
    z[df < 3] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    index = np.full(width, -1)
    index[chosen] = np.arange(len(chosen))
    inside = index[col] >= 0
    row, col = row[inside], index[col[inside]]
    w, e, b = np.zeros(len(chosen)), np.zeros(dense.shape[1]), bias
    size = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, e, np.zeros(1))]
    for step in range(1, steps + 1):
        out = np.bincount(row, weights=w[col], minlength=len(y)) + dense @ e + b
        error = np.where(use, _sigmoid(out) - y, 0) / n
        grads = (np.bincount(col, weights=error[row], minlength=len(w)) + 1e-4 * w, dense.T @ error + 1e-4 * e, np.array([error.sum()]))
        moves = []
        for (m, v), g in zip(size, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moves.append(0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8))
        w, e, b = w - moves[0], e - moves[1], b - float(moves[2][0])
    weight[chosen] = w
    return weight, e, b


@dataclass
class Chain:
    names: list[str]
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # (features, categories)
    before: np.ndarray  # (categories, categories): what earlier logits add
    bias: np.ndarray
    threshold: float  # for the last category

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        row, marks = features_of(texts)
        at = np.minimum(np.searchsorted(self.features, marks), max(len(self.features) - 1, 0))
        known = self.features[at] == marks if len(self.features) else np.zeros(len(marks), bool)
        width = max(len(self.features), 1)
        pairs = np.unique(row[known] * width + at[known])
        row, col = pairs // width, pairs % width
        out = np.zeros((len(texts), len(self.names)))
        logits = np.zeros_like(out)
        for c in range(len(self.names)):
            base = np.bincount(row, weights=self.weights[col, c], minlength=len(texts)) if len(row) else 0
            out[:, c] = _sigmoid(base + self.bias[c] + logits @ self.before[c])
            logits[:, c] = _logit(out[:, c])
        return out


def fit_chain(texts: list[str], targets: dict[str, np.ndarray]) -> Chain:
    """A chain over ``targets`` (0/1 per text) in their order. Without texts, or with one class only, it predicts the prior."""
    n, rows, marks = len(texts), [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for start in range(0, n, 256):  # only what is kept of a block outlives it
        row, mark = features_of(words.text_array(pa.array(texts[start:start + 256], pa.string())))
        rows.append((row + start).astype(np.int32))
        marks.append(mark)
    row, mark = np.concatenate(rows), np.concatenate(marks)
    features, df = np.unique(mark, return_counts=True)
    features = features[df >= LEAST_TEXTS]
    width = len(features)
    at = np.minimum(np.searchsorted(features, mark), max(width - 1, 0))
    known = features[at] == mark if width else np.zeros(len(mark), bool)
    pairs = np.unique(row[known].astype(np.int64) * max(width, 1) + at[known])
    row, col = pairs // max(width, 1), pairs % max(width, 1)
    del rows, marks, mark, at, known, pairs
    part = np.arange(n) % PARTS
    logits = np.zeros((n, len(targets)))
    weights, before, bias = np.zeros((width, len(targets))), np.zeros((len(targets), len(targets))), np.zeros(len(targets))
    last = np.zeros(n)
    for c, y in enumerate(targets.values()):
        y = y.astype(float)
        seen = logits[:, :c]
        for k in range(PARTS):
            w, e, b = _fit(row, col, width, seen, y, part != k)
            out = np.bincount(row, weights=w[col], minlength=n) + seen @ e + b
            last[part == k] = _sigmoid(out)[part == k]
        logits[:, c] = _logit(last)
        weights[:, c], before[c, :c], bias[c] = _fit(row, col, width, seen, y, np.ones(n, bool))
    used = (weights != 0).any(1)
    return Chain(list(targets), features[used], weights[used], before, bias, _threshold(last, y) if n else 1.0)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold predictions give the best F1: the middle of the best gap; above all of them if no row is positive."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][np.diff(p[order]) == 0] = 0  # equal predictions are not parted
    best = int(np.argmax(f1))
    return float((p[order[best]] + (p[order[best + 1]] if best + 1 < len(p) else 0)) / 2)


def learn_toxicity(docs: DataFrame, labels: DataFrame, chain: dict[str, str] | None = None, rows: int = SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text", inputs: tuple[str, ...] = ("lang",)) -> Chain:
    """A chain fitted on at most ``rows`` labelled rows; ``chain`` names categories and their SQL over labels and ``inputs``."""
    chain = chain or CHAIN
    sample = training_sample(docs, labels, chain, rows, id_col, text_col, list(inputs))
    return fit_chain([r["text"] for r in sample], {c: np.array([r[c] for r in sample]) for c in chain})


def score_toxicity(docs: DataFrame, model: Chain, text_col: str = "text", carry: list[str] | None = None,
                   verdict: str = "is_toxic") -> DataFrame:
    """``carry`` columns (all by default) with p_<category> for each category of the chain and ``verdict``.

    Whole texts are scored; null and empty texts get the chain's bias and repeated rows equal scores. Columns named like a
    result are replaced. An empty table gives no rows.
    """
    made = [f"p_{c}" for c in model.names]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {*made, verdict.lower()}]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.shards(batch, text_col):
                p = model.probabilities(texts)
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(p[:, c]) for c in range(len(made))), pa.array(p[:, -1] >= model.threshold)],
                    names=[*carry, *made, verdict])

    schema = with_fields(docs, carry, ", ".join(f"`{c}` double" for c in made) + f", `{verdict}` boolean")
    return docs.select(*map(field, dict.fromkeys([*carry, text_col]))).mapInArrow(scan, schema)


def drop_toxic(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain's last category does not reject, with the columns of ``docs``."""
    (stem,) = fresh(docs, "own")
    named = docs.withColumnsRenamed({c: f"{stem}{k}" for k, c in enumerate(docs.columns)})
    clean = score_toxicity(named, model, named.columns[docs.columns.index(text_col)], verdict=f"{stem}bad").where(~field(f"{stem}bad"))
    return clean.select(*(field(f"{stem}{k}").alias(c) for k, c in enumerate(docs.columns)))


def op1_classifier_chain(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", "text"), model, carry=["doc_id"]).select(
        "doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in model.names), "is_toxic")
