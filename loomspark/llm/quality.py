"""Document quality by co-training two views.

The content view sees statistics of the text, the metadata view only language,
source and recorded length. Each round, each view scores every unlabelled document, and
a bounded number of those it is sure of become pseudo-labels in the other view's training set. Both are
then calibrated on labels that they were not fitted on, and a regression over their calibrated
log odds scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._fit import logistic, score, sigmoid
from loomspark.llm._split import column, filtered
from loomspark.llm._store import stored
from loomspark.llm._text import BYTES, blocks, split

SOURCES = 64
_KIND = np.zeros(256, np.int64)  # 0 lower and multi-byte, 1 upper, 2 digit, 3 space, 4 line end, 5 usual punctuation, 6 other
_KIND[[b for b in range(128) if not chr(b).isalnum()]] = 6
_KIND[65:91], _KIND[48:58], _KIND[[32, 9, 11, 12, 13]], _KIND[10] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 5


def content_view(block: pa.RecordBatch) -> np.ndarray:
    """Statistics of each text: character kinds, word lengths, repetition of words, word pairs and lines."""
    words = split(block.column("text"), BYTES)
    lines = split(block.column("text"), BYTES, np.arange(256) == 10)
    pairs = words.grams(2)
    out = []
    for i in range(len(block)):
        a, z = int(words.first[i]), int(words.first[i + 1])
        if a == z:
            out.append([0.0] * 13)
            continue
        data = words.data[words.start[a] : words.end[z - 1]]
        kinds = np.bincount(_KIND[data], minlength=7) / len(data)
        n = z - a
        length = words.end[a:z] - words.start[a:z]
        last = _KIND[words.data[words.end[a:z] - 1]]
        _, often = np.unique(words.hash[a:z], return_counts=True)
        two = len(np.unique(pairs[a : z - 1])) / (n - 1) if n > 1 else 1.0
        la, lz = int(lines.first[i]), int(lines.first[i + 1])
        out.append([*kinds[[1, 2, 4, 5, 6]], (last == 6).mean(), np.log1p(n), length.mean() / 10, length.std() / 10, len(often) / n, often.max() / n, two, len(np.unique(lines.hash[la:lz])) / (lz - la)])
    x = np.array(out, float).reshape(len(block), 13)
    return np.column_stack([x, x**2])


def metadata_view(block: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Hashed language and source, and the recorded length; nulls have their own place."""
    x = np.zeros((len(block), SOURCES + 16 + 3))
    for i, (lang, source, size) in enumerate(zip(*(block.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)):
        x[i, zlib.crc32(repr(source).encode()) % SOURCES] = 1
        x[i, SOURCES + zlib.crc32(repr(lang).encode()) % 16] = 1
        level = np.log1p(max(size or 0, 0)) / 10
        x[i, -3:] = level, level**2, size is None
    return x


@dataclass
class CoModel:
    content: np.ndarray
    metadata: np.ndarray
    scale: np.ndarray  # of both views' log odds: slope and offset each
    joint: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    learned: tuple[int, int] = (0, 0)  # pseudo-labels that the content and the metadata view were given

    def views(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views."""
        a, b = score((c - self.mean) / self.std, self.content), score(m, self.metadata)
        return np.column_stack([a * self.scale[0, 0] + self.scale[0, 1], b * self.scale[1, 0] + self.scale[1, 1]])

    def odds(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        return score(self.views(c, m), self.joint)


FOLDS = 5


@dataclass
class Learner:
    """Both views of labelled rows with labels y (1: good), and the pseudo-labelled rows that each view has been given."""

    c: np.ndarray
    m: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        self.mean, self.std = self.c.mean(axis=0), self.c.std(axis=0) + 1e-6
        self.fold = np.arange(len(self.y)) % FOLDS
        self.given: dict[str, dict[str, tuple[np.ndarray, int]]] = {"c": {}, "m": {}}  # row: its features, pseudo-label

    def shaped(self, view: str, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std if view == "c" else x

    def fit(self, view: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, calibration (slope and offset) and held-out log odds of the labelled rows: each fold is scored by weights from the others."""
        x = self.shaped(view, self.c if view == "c" else self.m)
        extra = [self.given[view][k] for k in sorted(self.given[view])]
        more = self.shaped(view, np.array([f for f, _ in extra]).reshape(len(extra), x.shape[1]))
        labels = np.array([label for _, label in extra], float)
        fitted = lambda rows: logistic(np.concatenate([x[rows], more]), np.concatenate([self.y[rows], labels]))
        odds = np.zeros(len(self.y))
        for k in range(FOLDS):
            here = self.fold == k
            if here.any():
                odds[here] = score(x[here], fitted(~here))
        return fitted(np.ones(len(self.y), bool)), logistic(odds[:, None], self.y), odds

    def model(self) -> CoModel:
        fits = {v: self.fit(v) for v in ("c", "m")}
        scale = np.array([fits[v][1] for v in ("c", "m")])
        views = np.column_stack([fits[v][2] * fits[v][1][0] + fits[v][1][1] for v in ("c", "m")])
        return CoModel(fits["c"][0], fits["m"][0], scale, logistic(views, self.y), self.mean, self.std, (len(self.given["c"]), len(self.given["m"])))


def co_train(learner: Learner, ask, *, rounds: int, give: int) -> CoModel:  # noqa: ANN001
    """rounds times, each view gives the other up to `give` rows. ask(model, view, label, most) finds unlabelled rows that the view is sure of, as {row: (features of the other view, label)}."""
    for _ in range(rounds):
        model = learner.model()
        for view, to in (("c", "m"), ("m", "c")):
            share = float(learner.y.mean())
            for label, part in ((1, share), (0, 1 - share)):
                found = ask(model, view, label, int(give * part))
                learner.given[to].update({k: v for k, v in found.items() if k not in learner.given[to]})
    return learner.model()


def no_labels() -> CoModel:
    """Every document is as good as the next."""
    c, m = 2 * 13, SOURCES + 16 + 3
    return CoModel(np.zeros(c + 1), np.zeros(m + 1), np.array([[1.0, 0], [1.0, 0]]), np.array([0.0, 0, 3.0]), np.zeros(c), np.ones(c))


_FEATURES = "doc_id long, lang string, source string, n_chars long, c array<double>"


def _seen(docs: DataFrame, text: str) -> list[Column]:
    """The columns both views read; missing metadata is null."""
    kinds = (("lang", "string"), ("source", "string"), ("n_chars", "long"))
    extra = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in kinds]
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"), *extra]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the columns of the metadata view and c, the statistics of the content view: about a twentieth of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                c = content_view(block)[:, :13]
                yield pa.RecordBatch.from_arrays([*(block.column(x) for x in ("doc_id", "lang", "source", "n_chars")), _rows_of(c)], ["doc_id", "lang", "source", "n_chars", "c"])

    return docs.select(*_seen(docs, text)).mapInArrow(run, _FEATURES)


def _rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _views_of(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cells = table.column("c")
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    c = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(table), 13)
    return np.column_stack([c, c**2]), metadata_view(table)


def _by_hash(*names: str) -> list[Column]:
    """The order in which bounded samples are taken: of a hash of doc_id, then of all that tells rows apart."""
    return [F.xxhash64("doc_id"), F.col("doc_id"), *map(F.col, names), F.xxhash64("c", "lang", "source", "n_chars")]


def train(docs: DataFrame, labels: DataFrame, *, most: int = 10_000, rounds: int = 4, give: int = 2_000, sure: float = 0.95, text: str = "text") -> CoModel:
    """Co-trains on labels (doc_id, quality 0 or 1) and all documents without one.

    Fits see at most `most` labelled documents and, each round, `give` pseudo-labelled ones for each view, so at most
    most + rounds * give rows come to the driver. Both bounds take the smallest hashes of doc_id; pseudo-labels are
    chosen among all unlabelled documents of which the giving view is sure (calibrated on held-out labels). The statistics of the
    texts are computed once and stored. Null doc_ids get no label; no labels at all: every document is kept.
    """
    rows = stored(features(docs, text), "features")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = stored(known, "labels")
    few = rows.join(known, "doc_id").orderBy(*_by_hash()).limit(most).toArrow()
    if not len(few):
        return no_labels()
    c, m = _views_of(few)
    learner = Learner(c, m, few.column("quality").to_numpy().astype(float))
    rest = stored(rows.join(known, "doc_id", "left_anti"), "unlabelled")

    def ask(model: CoModel, view: str, label: int, n: int) -> dict[str, tuple[np.ndarray, int]]:
        held = rest.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = sigmoid(held.value.views(*_views_of(b))[:, "cm".index(view)])
                yield b.filter(pa.array((p if label else 1 - p) >= sure))

        got = rest.mapInArrow(run, _FEATURES).orderBy(*_by_hash()).limit(n).toArrow()
        x = _views_of(got)["cm".index(view) ^ 1] if len(got) else []
        return {repr(r): (f, label) for r, f in zip(zip(*(got.column(k).to_pylist() for k in ("doc_id", "lang", "source", "n_chars")), strict=True), x, strict=True)}

    return co_train(learner, ask, rounds=rounds, give=give)


def score_quality(docs: DataFrame, model: CoModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, p_content, p_metadata, p_good, keep (p_good >= least).

    Null and empty texts have the statistics 0 and are scored like others; null or missing
    metadata has its own place; repeated rows repeat; other columns are not read; an
    empty table gives an empty result. No shuffle.
    """
    rows = docs.select(*_seen(docs, text))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                c, m = content_view(block), metadata_view(block)
                views = sigmoid(held.value.views(c, m))
                p = sigmoid(held.value.odds(c, m))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(p), pa.array(p >= least)], ["doc_id", "p_content", "p_metadata", "p_good", "keep"])

    return rows.mapInArrow(run, "doc_id long, p_content double, p_metadata double, p_good double, keep boolean")


def keep_good(docs: DataFrame, model: CoModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality keeps. Scored in place: no join, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = lambda block: sigmoid(held.value.odds(content_view(block), metadata_view(block))) >= least
    return filtered(docs, _seen(docs, text), ["doc_id", "text", "lang", "source", "n_chars"], keep, text)
