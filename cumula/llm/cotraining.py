"""Quality by co-training: a view of the words and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import HELD_OUT_FOLD, fold

#: Hash buckets of each view, rounds, and the chance from which a pseudo-label counts as confident.
WORD_BUCKETS, PAGE_BUCKETS, ROUNDS, CONFIDENT = 1 << 16, 1 << 12, 2, 0.95
#: Most labelled rows of each class that are read: the bound of the sample.
SAMPLE_PER_CLASS, CALIBRATION_FOLD, MEMO_WORDS = 3000, 1, 400_000
WORDS, PAGE = 0, 1


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = k = crc32(word.encode()) % WORD_BUCKETS
        return k


_WORDS = _Buckets()


def word_buckets(text: str | None) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


def page_buckets(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Language, source, and the page's size and layout in powers of two; never its words."""
    n, lines = len(text or ""), (text or "").count("\n") + 1
    size, rows, width = n.bit_length(), lines.bit_length(), (n // lines).bit_length()
    traits = (f"lang={lang}", f"source={source}", f"size={size}", f"lines={rows}", f"width={width}", f"shape={rows}x{width}")
    return np.array([crc32(t.encode()) % PAGE_BUCKETS for t in traits], np.int64)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the constant of a logistic fit by Newton steps; classes weigh the same."""
    design = np.column_stack((x, np.ones(len(x))))
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    ridge, w = np.eye(design.shape[1]) * penalty, np.zeros(design.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (share * (p - y)) + ridge @ w
        hess = (design * (share * p * (1 - p))[:, None]).T @ design + ridge
        w -= np.linalg.solve(hess, grad)
    return w


@dataclass
class View:
    """Multinomial classifier over buckets: counts by class, and a calibrated logit."""

    counts: np.ndarray  # 2 x buckets
    mean: bool  # whether a document's evidence is divided by its length
    slope: float = 1.0
    constant: float = 0.0

    def table(self) -> np.ndarray:
        smooth = self.counts + 0.5
        logs = np.log(smooth / smooth.sum(1, keepdims=True))
        return np.where(self.counts.sum(0) > 0, logs[1] - logs[0], 0.0)

    def evidence(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return np.array([(float(table[d].mean()) if self.mean else float(table[d].sum())) if len(d) else 0.0 for d in docs])

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        x = self.evidence(docs, self.table())
        if y.any() and not y.all():
            spread = x.std() or 1.0
            w = logistic((x / spread)[:, None], y)
            self.slope, self.constant = float(w[0] / spread), float(w[1])


@dataclass
class Model:
    views: tuple[View, View]
    combined: np.ndarray  # weight of each view's logit, constant

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.views[WORDS].table(), self.views[PAGE].table()


def _counts(docs: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros((2, buckets))
    for d, k in zip(docs, y, strict=True):
        out[int(k)] += np.bincount(d, minlength=buckets)
    return out


def _view(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _logits(model: Model, tables: tuple[np.ndarray, np.ndarray], b: pa.RecordBatch) -> tuple[list, list, np.ndarray, np.ndarray]:
    cols = [b.column(c).to_pylist() for c in ("text", "lang", "source")]
    words, pages = [word_buckets(t) for t in cols[0]], [page_buckets(*row) for row in zip(*cols, strict=True)]
    logit = [v.slope * v.evidence(d, t) + v.constant for v, d, t in zip(model.views, (words, pages), tables, strict=True)]
    return words, pages, logit[WORDS], logit[PAGE]


def _exchange(docs: DataFrame, model: Model, confident: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts that each view gains from the documents the other one is sure of, over all documents."""
    shared, edge = docs.sparkSession.sparkContext.broadcast(model), float(np.log(confident / (1 - confident)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables, gains = own.tables(), [np.zeros((2, WORD_BUCKETS), np.int64), np.zeros((2, PAGE_BUCKETS), np.int64)]
        for b in batches:
            words, pages, by_words, by_page = _logits(own, tables, b)
            for k in range(len(words)):
                if abs(by_page[k]) >= edge and len(words[k]):
                    gains[WORDS][int(by_page[k] > 0)] += np.bincount(words[k], minlength=WORD_BUCKETS)
                if abs(by_words[k]) >= edge:
                    np.add.at(gains[PAGE][int(by_words[k] > 0)], pages[k], 1)
        for view, gain in enumerate(gains):
            label, bucket = np.nonzero(gain)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), view), pa.int32()), pa.array(label, pa.int32()), pa.array(bucket, pa.int32()), pa.array(gain[label, bucket], pa.int64())], names=["view", "label", "bucket", "n"])

    rows = docs.mapInArrow(run, "view int, label int, bucket int, n long").groupBy("view", "label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, WORD_BUCKETS)), np.zeros((2, PAGE_BUCKETS))
    view, label, bucket, n = (rows.column(c).to_numpy() for c in ("view", "label", "bucket", "n"))
    for k in (WORDS, PAGE):
        out[k][label[view == k], bucket[view == k]] = n[view == k]
    return out


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Two views trained on labels.quality and on each other's confident verdicts over all documents.

    At most ``per_class`` labelled rows of each class outside the held-out fold
    start the views, those of fold 1 calibrate. In every round each view counts
    all documents of which the other is sure, added to its labelled rows; what
    comes back to the driver is one count for each bucket and class.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    usable = usable.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT_FOLD)
    order = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    ids = usable.where("y = 1").orderBy(order, "doc_id").limit(per_class).union(usable.where("y = 0").orderBy(order, "doc_id").limit(per_class))
    view = _view(docs)
    one = view.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "fold", "y").agg(F.min(F.struct("text", "lang", "source")).alias("row"))  # an id may be in many rows
    rows = sorted(one.select("doc_id", "fold", "y", "row.*").collect(), key=lambda r: (r.doc_id, r.y))
    words, pages = [word_buckets(r.text) for r in rows], [page_buckets(r.text, r.lang, r.source) for r in rows]
    y, calibrates = np.array([r.y == 1 for r in rows], bool), np.array([r.fold == CALIBRATION_FOLD for r in rows], bool)
    if not (~calibrates).any() or not calibrates.any():
        calibrates = np.zeros(len(rows), bool)
    own = np.flatnonzero(~calibrates)
    rest = np.flatnonzero(calibrates) if calibrates.any() else own
    base = _counts([words[i] for i in own], y[own], WORD_BUCKETS), _counts([pages[i] for i in own], y[own], PAGE_BUCKETS)
    model = Model((View(base[WORDS], True), View(base[PAGE], False)), np.array([1.0, 1.0, 0.0]))
    held = [words[i] for i in rest], [pages[i] for i in rest]
    for k in range(rounds + 1):
        for v, d in zip(model.views, held, strict=True):
            v.calibrate(d, y[rest])
        if k < rounds and len(rows):
            gains = _exchange(view, model, confident)
            model = Model(tuple(View(b + g, v.mean) for v, b, g in zip(model.views, base, gains, strict=True)), model.combined)
    if len(rest) and y[rest].any() and not y[rest].all():
        x = np.column_stack([v.slope * v.evidence(d, v.table()) + v.constant for v, d in zip(model.views, held, strict=True)])
        model.combined = logistic(np.clip(x, -8, 8), y[rest], penalty=0.1)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, by_words, by_page) for each row of ``docs`` (doc_id, text, lang, source).

    score is the combined chance of high quality, the others are what each view
    says alone. Null and empty texts have no words; null lang and source are
    values of their own; categories never seen say nothing. Repeated rows and
    rows without an id are scored alike, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables()
        for b in batches:
            _, _, by_words, by_page = _logits(own, tables, b)
            both = np.clip(np.column_stack((by_words, by_page)), -8, 8) @ own.combined[:2] + own.combined[2]
            chance = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (both, by_words, by_page)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.float64()) for c in chance)], names=["doc_id", "score", "by_words", "by_page"])

    return _view(docs).mapInArrow(run, "doc_id long, score double, by_words double, by_page double")
