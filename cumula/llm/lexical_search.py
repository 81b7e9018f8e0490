"""Ranked lexical search: posting lists with range-maximum tables, best-first over intervals of documents."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumula.llm.common import documents_view, slices, texts, written

#: Documents of a segment and postings from which one closes; items, and bytes of them, searched for at once on average;
#: intervals split in a step and cells of its matrices; documents that a segment scores for an item's first threshold.
SEGMENT_DOCS, SEGMENT_POSTINGS, ITEMS, ITEM_BYTES, STEP, STEP_CELLS, FIRST_LOOK = 8192, 1 << 20, 2048, 1 << 24, 64, 1 << 16, 256
#: A document's id where it has none; such documents come last among equal scores.
NO_ID = np.iinfo(np.int64).max

#: ASCII letters and digits stay, capitals become small, other ASCII parts terms; bytes of other characters belong to terms.
_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: maximal stretches of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    """Integer weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What occurrences of terms add to a score, in integers."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


SEGMENTS = "n_docs long, n_terms long, terms binary, counts binary, doc_ids binary, lengths binary, at binary, tf binary"


def _segments(vocabulary: dict[bytes, int]):
    """Posting lists of the vocabulary's terms, a row for each segment: terms with the number of their postings, and by posting the document's place and the term's occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, own, held, n_docs, n_terms = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            doc_ids = np.array(ids, np.int64)
            order = np.lexsort((doc_ids, lengths)) if ids else np.zeros(0, np.int64)  # texts of like length bound each other best
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = [len(o) for o in own]
            at = np.repeat(place, sizes)
            term = np.fromiter((t for o in own for t in o), np.int64, sum(sizes))
            tf = np.fromiter((f for o in own for f in o.values()), np.int64, sum(sizes))
            by = np.lexsort((at, term))
            terms, counts = np.unique(term, return_counts=True)
            packed = [terms.astype(np.int32), counts.astype(np.int32), doc_ids[order], np.array(lengths, np.int64)[order], at[by].astype(np.int32), tf[by].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["n_docs", "n_terms", "terms", "counts", "doc_ids", "lengths", "at", "tf"])

        for b in slices(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                found = terms_of(t)
                if not found:
                    continue
                n_docs += 1
                n_terms += len(found)
                freq = Counter(vocabulary[x] for x in found if x in vocabulary)
                if freq:
                    ids.append(NO_ID if d is None else d)
                    lengths.append(len(found))
                    own.append(freq)
                    held += len(freq)
                    if len(ids) == SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                        yield close()
                        ids, lengths, own, held, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield close()

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, over the segments of a partition."""
    total: np.ndarray = np.zeros(0, np.int64)
    for b in batches:
        for terms, counts in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True):
            t = np.frombuffer(terms, np.int32)
            if len(t):
                total = np.concatenate((total, np.zeros(max(0, int(t[-1]) + 1 - len(total)), np.int64)))
                total[t] += np.frombuffer(counts, np.int32)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])


class RangeMaxima:
    """Sparse table over consecutive posting lists of ``longest`` values at most: where the greatest of any range within a list stands."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            last = self.levels[-1]
            a, b = last[: len(values) - 2 * step + 1], last[step : step + len(values) - 2 * step + 1]
            level = np.zeros(len(values), np.int32)
            level[: len(a)] = np.where(values[a] >= values[b], a, b)
            self.levels.append(level)
            step *= 2
        self.table = np.concatenate(self.levels)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each range and where it stands; zero for an empty range."""
        size = end - start
        k = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        n = len(self.values)
        lo = np.minimum(start, n - 1)
        a, b = self.table[k * n + lo], self.table[k * n + np.maximum(lo, end - (1 << k))]
        top = np.where(self.values[a] >= self.values[b], a, b)
        return np.where(size > 0, self.values[top], 0), top


class Segment:
    """Posting lists of one segment, ready for search."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids, length = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.terms, counts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["counts"], np.int32)
        at, tf = np.frombuffer(row["at"], np.int32).astype(np.int64), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.size = len(self.doc_ids)
        m = 10 + (90 * length * n_docs) // max(n_terms, 1)
        self.at = at
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.size + at
        self.maxima = RangeMaxima(impacts(np.repeat(weights[self.terms], counts), tf, m[at]), int(counts.max()) if len(counts) else 0)

    def best(self, terms: np.ndarray, top: int, floor: int = 0, looks: int | None = None) -> list[tuple[int, int]]:
        """(score, doc_id) of the documents with the highest scores above 0 and not below ``floor``, equal scores by lower id.

        Intervals of documents wait in order of the sum of their lists' greatest
        impacts, which no document inside exceeds. The greatest are split at the
        document of their greatest impact, which is scored, until none left
        could enter the result. With ``looks`` the search ends after about so many
        documents, and what it returns is only part of the answer.
        """
        if not len(self.terms):
            return []
        rows = np.searchsorted(self.terms, terms)
        rows = rows[(rows < len(self.terms)) & (self.terms[np.minimum(rows, len(self.terms) - 1)] == terms)]
        if not len(rows):
            return []
        base, values = rows * self.size, self.maxima.values
        step = max(1, min(STEP, STEP_CELLS // len(rows)))
        waiting: list[tuple[int, int, int, int]] = []  # (-bound, first place, place behind the last, where to split)
        best: list[tuple[int, int]] = []  # (score, -doc_id), the worst first
        scored = 0

        def enough() -> int:
            return max(floor, best[0][0] if len(best) == top else 1, 1)

        def wait(first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            greatest, where = self.maxima(a, b)
            bound = greatest.sum(1)
            keep = np.flatnonzero(bound >= enough())
            split = self.at[where[keep, greatest[keep].argmax(1)]]
            for entry in zip((-bound[keep]).tolist(), first[keep].tolist(), last[keep].tolist(), split.tolist(), strict=True):
                heapq.heappush(waiting, entry)

        def places(documents: np.ndarray) -> np.ndarray:
            return np.searchsorted(self.keys, base + documents[:, None])

        wait(np.zeros(1, np.int64), np.full(1, self.size), *(np.where(rows > 0, self.ends[rows - 1], 0)[None, :], self.ends[rows][None, :]))
        while waiting and (looks is None or scored < looks):
            taken = []
            while waiting and len(taken) < step and -waiting[0][0] >= enough():
                taken.append(heapq.heappop(waiting))
            if not taken:
                break
            _, first, last, doc = np.array(taken).T
            p = places(doc)
            here = self.keys[np.minimum(p, len(self.keys) - 1)] == base + doc[:, None]
            score = np.where(here, values[np.minimum(p, len(values) - 1)], 0).sum(1)
            scored += len(doc)
            for s, d in zip(score.tolist(), self.doc_ids[doc].tolist(), strict=True):
                entry = (s, -d)
                if s >= max(floor, 1):
                    if len(best) < top:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            wait(np.concatenate((first, doc + 1)), np.concatenate((doc, last)), np.concatenate((places(first), p + here)), np.concatenate((p, places(last))))
        return [(s, -d) for s, d in best]


HITS = "query int, doc_id long, score long"


def _hits(lists: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int, floors: dict[int, int], looks: int | None):
    """The best documents of each segment for each list of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                segment = Segment(row, weights, n_docs, n_terms)
                found = [(q, d, s) for q, terms in enumerate(lists) for s, d in segment.best(terms, top, floors.get(q, 0), looks)]
                query, doc, score = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(view: DataFrame, items: list, top: int) -> DataFrame:
    """Results of one block of items (item_id, text)."""
    spark, vocabulary = view.sparkSession, {}
    lists = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(i.text)}), np.int32) for i in items]
    segments = written(view.mapInArrow(_segments(vocabulary), SEGMENTS))
    n_docs, n_terms = (x or 0 for x in segments.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in segments.select("terms", "counts").mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = weight(n_docs, df)
    looked = segments.mapInArrow(_hits(lists, weights, n_docs, n_terms, top, {}, FIRST_LOOK), HITS)
    floors = dict(_ranked(looked, top).where(F.col("rank") == top).select("query", "score").collect())
    hits = segments.mapInArrow(_hits(lists, weights, n_docs, n_terms, top, floors, None), HITS)
    names = spark.createDataFrame([(q, i.item_id) for q, i in enumerate(items)], "query int, item_id long")
    ranked = _ranked(hits, top).join(F.broadcast(names), "query")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each row of ``items`` (item_id, text).

    Returns (item_id, rank, doc_id, score), equal scores by ascending doc_id,
    those without an id last. Documents are indexed once for each block of items:
    posting lists of the items' terms by segments of bounded size, written to the
    shared folder. Each segment first looks at the documents of greatest impacts;
    the worst of the ``top`` so found bounds the full search, in which each segment
    passes on its own best, so that an item's rows are ``top`` for each segment.
    A document without a term counts nowhere; null and empty items and items
    whose terms no document holds have no rows; repeated rows of either table are
    documents or items of their own; extra columns are not read.
    """
    spark, view = docs.sparkSession, documents_view(docs)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, size = wanted.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // ITEMS), -(-(size or 0) // ITEM_BYTES))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        own = dealt.where(F.col("block") == k).collect()
        if own:
            out = out.unionByName(_search(view, own, top))
    return out
