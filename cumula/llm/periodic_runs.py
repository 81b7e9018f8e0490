"""Periodic runs of words: stretches that repeat a period, by merging suffix classes in the order of falling common prefixes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import documents_view, slices

#: Words and repeats that a run has at least, and positions in a chunk of an ordered set.
LEAST_WORDS, LEAST_REPEATS, CHUNK = 24, 3, 512

Run = tuple[int, int, int]  # start, length, period


class _Positions:
    """An ordered set of positions in chunks, so that neither a search nor an insertion passes over all of it."""

    def __init__(self, position: int):
        self.chunks, self.heads, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.chunks)

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The nearest positions before and behind one that is not in the set."""
        k = bisect_right(self.heads, x) - 1
        if k < 0:
            return None, self.heads[0]
        own = self.chunks[k]
        at = bisect_left(own, x)
        after = own[at] if at < len(own) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return own[at - 1], after

    def add(self, x: int) -> None:
        k = max(bisect_right(self.heads, x) - 1, 0)
        own = self.chunks[k]
        own.insert(bisect_left(own, x), x)
        self.heads[k] = own[0]
        self.size += 1
        if len(own) > 2 * CHUNK:
            self.chunks[k : k + 1] = [own[:CHUNK], own[CHUNK:]]
            self.heads.insert(k + 1, own[CHUNK])


def _repeated(words: np.ndarray, gram: int) -> bool:
    """Whether two stretches of ``gram`` words (a power of two) may be equal: never false where two are."""
    h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    k = 1
    while k < gram:
        h = h[:-k] * np.uint64(0xBF58476D1CE4E5B9) + (h[k:] ^ (h[k:] >> np.uint64(31)))
        k *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of numbers in order, and the common prefix of each with the next, by doubling."""
    n, k = len(words), 1
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while k < n and levels[-1].max() + 1 < n:
        behind = np.full(n, -1)
        behind[: n - k] = levels[-1][k:]
        levels.append(np.unique(levels[-1] * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        room = np.flatnonzero(np.maximum(a, b) + common < n)
        at = common[room]
        same = levels[step][a[room] + at] == levels[step][b[room] + at]
        common[room[same]] += 1 << step
    return order, common


def runs_of(words: list, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[Run]:
    """All runs of a sequence by start, then period: (start, length, period).

    A run is a stretch with smallest period q that no neighbour extends keeping
    it, of ``least_words`` words and ``least_repeats`` (2 at least) periods or more.
    Suffixes are united into classes by falling common prefixes, as in Kruskal's
    algorithm; each class keeps its positions in order and the smaller is added
    to the larger. Positions that become neighbours at distance q while their
    common prefix is l of at least q words start a run of q + l words, unless the
    word ahead extends it, which the position before then tells.
    """
    if least_repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    shared = -(-least_words * (least_repeats - 1) // least_repeats)  # words that a run's start has in common with the next period
    if len(words) < least_words:
        return []
    known: dict = {}
    w = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
    if not _repeated(w, 1 << (max(shared, 1).bit_length() - 1)):
        return []
    order, common = suffixes(w)
    edges = np.flatnonzero(common >= max(shared, 1))
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, _Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], classes[x] = x, _Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found: list[Run] = []
    for x, y, l in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist(), strict=True):  # noqa: E741
        small, large = root(x), root(y)
        if classes[small].size > classes[large].size:
            small, large = large, small
        into, members = classes[large], list(classes.pop(small))
        for before, p, after in zip([-1, *members[:-1]], members, [*members[1:], len(w)], strict=True):
            left, right = into.around(p)
            for s, e in ((left, p) if left is not None and left > before else (0, 0), (p, right) if right is not None and right < after else (0, 0)):
                q = e - s
                if 0 < q and q * (least_repeats - 1) <= l and q + l >= least_words and not (s and w[s - 1] == w[e - 1]):
                    found.append((s, q + l, q))
        for p in members:
            into.add(p)
        parent[small] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """Words without those that stand behind the first period of a run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) with its runs of words and its text without their repeats.

    Words are cut at ASCII white space; ``prepare`` may change those of a document
    first. ``collapsed`` has the words left, joined by one space. Each document is
    worked on alone and whole, so nothing is shuffled. Null and empty texts and
    texts without words have no run and an empty collapsed text; repeated rows
    stay; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            sizes, runs, left = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = (t or "").encode().split()
                if prepare:
                    words = prepare(d, words)
                found = runs_of(words, least_words, least_repeats)
                sizes.append(len(words))
                runs.append(found)
                left.append(b" ".join(collapse(words, found)))
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            entries = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), entries), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return documents_view(docs).mapInArrow(run, RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the one with most repeats (ties: least start, then period), and digests of all and of the text left."""
    more = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    top = F.aggregate("runs", F.try_element_at(F.col("runs"), F.lit(1)), lambda a, b: F.when(more(a, b), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, top).alias("top"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.expr("top.length * 1000 div top.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
