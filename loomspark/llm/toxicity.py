"""Toxicity by cumulative-link ordinal regression over hashed words.

P(grade <= k) = sigmoid(threshold_k - w.x): all thresholds share the weights w,
and x marks which hashed words a text has. The expected severity is the sum
of P(grade > k) over the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._fit import sigmoid
from loomspark.llm._text import FOLDED, PUNCT, blocks, split

BITS = 20
#: Bytes of a word's beginning that count as features of their own, so inflected forms share evidence.
STEMS = (4, 5, 6, 7)


def features(block: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text: its words and the first bytes of longer words, lower-cased in A-Z, without punctuation."""
    words = split(block.column("text"), FOLDED, PUNCT)
    found = [(words.hash, np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1)]
    for n in STEMS:
        at, hashes = words.prefixes(n)
        found.append((hashes, found[0][1][at]))
    keys = np.concatenate([(owner.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h, owner in found])
    keys = np.unique(keys)
    cuts = np.searchsorted(keys, np.arange(len(block) + 1) << BITS)
    ids = (keys & ((1 << BITS) - 1)).astype(np.int32)
    return [ids[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@dataclass
class OrdinalModel:
    """weights: one float for each of 2**BITS features; cuts: ascending thresholds; grades: their labels."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: list[int]

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows], float)

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return sigmoid(margin[:, None] - self.cuts[None, :])


def fit_ordinal(rows: list[np.ndarray], y: np.ndarray, *, grades: list[int], l2: float = 0.2, least: int = 5, sure: float = 5.0, steps: int = 400) -> OrdinalModel:
    """Adam on the ridge likelihood. Only features of at least least rows get a weight, and of these those
    whose rate among the higher grades is sure standard errors off the base rate. Absent grades get thresholds of their own prior."""
    k = len(grades)
    y = np.searchsorted(np.array(grades), y)
    n = len(rows)
    flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    df, up = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, weights=(y > 0)[owner], minlength=1 << BITS)
    base = min(max(float((y > 0).mean()), 1e-6), 1 - 1e-6)
    common = np.flatnonzero((df >= least) & (np.abs(up - df * base) >= sure * np.sqrt(df * base * (1 - base))))
    place = np.full(1 << BITS, -1)
    place[common] = np.arange(len(common))
    column = place[flat]
    column, owner = column[column >= 0], owner[column >= 0]
    m = len(common)
    w = np.zeros(m)
    at_least = np.array([((y > j).sum() + 0.5) / (n + 1) for j in range(k - 1)])
    cuts0 = -np.log(at_least / (1 - at_least))
    theta = np.concatenate([[cuts0[0]], np.log(np.maximum(np.diff(cuts0), 1e-3))]) if k > 1 else np.empty(0)
    params = np.concatenate([w, theta])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, theta = params[:m], params[m:]
        gaps = np.exp(theta[1:])
        cuts = np.concatenate([theta[:1], theta[:1] + np.cumsum(gaps)])
        margin = np.bincount(owner, weights=w[column], minlength=n)
        edges = np.concatenate([np.full((n, 1), -35.0), cuts[None, :] - margin[:, None], np.full((n, 1), 35.0)], axis=1)
        cdf = sigmoid(edges)
        low, high = cdf[np.arange(n), y], cdf[np.arange(n), y + 1]
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        g_margin = d_high - d_low
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, np.minimum(y, k - 2), np.where(y < k - 1, -d_high, 0))
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, d_low, 0))
        g_w = np.bincount(column, weights=g_margin[owner], minlength=m) + l2 * w
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        params = params - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    theta = params[m:]
    weights = np.zeros(1 << BITS, np.float32)
    weights[common] = params[:m]
    return OrdinalModel(weights, np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))]), grades)


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, grade of the most labelled documents with the smallest hash of doc_id."""
    ids = labels.where("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    ids = ids.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(ids), "doc_id")  # at most `most` rows


def train(docs: DataFrame, labels: DataFrame, *, most: int = 10_000, text: str = "text", grades: list[int] | None = None) -> OrdinalModel:
    """Fits on at most `most` labelled documents (doc_id, grade); whole texts. No labels at all: every text gets the lowest grade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                yield pa.RecordBatch.from_arrays([block.column("grade"), pa.array([r.tolist() for r in features(block)], pa.list_(pa.int32()))], ["grade", "ids"])

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    got = labelled_rows(clean, labels, most).select("grade", "text").mapInArrow(run, "grade int, ids array<int>").toArrow()
    y = np.asarray(got.column("grade"), dtype=np.int64)
    grades = grades or sorted(set(y.tolist()) | {0, 1})
    rows = [np.asarray(x.values if x.values is not None else [], dtype=np.int32) for x in got.column("ids")]
    if not len(y):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(len(grades) - 1, 35.0), grades)
    order = np.lexsort((y, [r.sum() for r in rows], [len(r) for r in rows]))  # the same sum whatever order rows come in
    return fit_ordinal([rows[i] for i in order], y[order], grades=grades)


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, text: str = "text", flag: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, severity (expected grade steps), p_toxic = P(grade > lowest), grade (most likely; the lower of equals), toxic.

    toxic means p_toxic >= flag. Null and empty texts have no features and get the base rate; null
    doc_ids stay; repeated rows repeat; other columns are not read; an empty table gives an empty
    result. The model (4 MB) is broadcast; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for block in blocks(b):
                above = m.above(m.margin(features(block)))
                chance = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
                grade = np.array(m.grades)[chance.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= flag)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
