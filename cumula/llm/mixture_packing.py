"""Windows of tokens filled in target proportions by a deficit round-robin over the queues of sources."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumula.llm.byte_bpe import byte_bpe
from cumula.llm.common import slices, texts, written

#: Tokens of a window, windows of a block, queues, parts and words a worker remembers, and rows of queue starts that are broadcast.
CAPACITY, BLOCK_WINDOWS, MOST_QUEUES, MEMO_PARTS, MEMO_WORDS, BROADCAST_ROWS = 4096, 64, 1024, 250_000, 800_000, 2_000_000


#: A part whose words the model alone can encode: signs (no apostrophe, no opening of a special string), Latin letters, signs.
_PLAIN = re.compile("([!-&(-/:;=>?@\\[-`{-~]*)([a-zß-öø-ÿ]*)([!-&(-/:;=>?@\\[-`{-~]*)")


class _Encoder:
    """Ids of whole texts as little-endian numbers; each distinct part between ASCII white space is encoded once while it is remembered.

    For tokenizers that lower-case and compose, whose pre-tokens are runs of
    letters or of signs and never hold white space. Small precomposed Latin letters
    stay as they are in all that, so of a run of them only the model's merges are
    left; the library encodes every other part whole.
    """

    def __init__(self, path: str):
        self.bpe, self.memo, self.former = byte_bpe(path), {}, {}
        self.words: dict[str, bytes] = {}
        tokenizer = self.bpe.tokenizer
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.bytes = str.maketrans({c: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters})

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == "<u2" else "I", ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.bpe.ids([text])[0])

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            if len(self.words) > MEMO_WORDS:
                self.words.clear()
            mapped = word if word.isascii() else word.translate(self.bytes)
            known = self.words[word] = self._packed([t.id for t in self.bpe.tokenizer.model.tokenize(mapped)])
        return known

    def _learn(self, part: bytes) -> bytes:
        if part.isalpha():  # ASCII letters alone
            return self._word(part.lower().decode())
        text = part.decode()
        found = _PLAIN.fullmatch(text.lower())
        if not found:
            return self._whole(text)
        ahead, word, behind = found.groups()
        return (self._signs(ahead) if ahead else b"") + (self._word(word) if word else b"") + (self._signs(behind) if behind else b"")

    def _signs(self, signs: str) -> bytes:
        known = self.words.get(signs)
        if known is None:
            known = self.words[signs] = self._whole(signs)
        return known

    def __call__(self, text: str) -> bytes:
        parts = text.encode().split()
        if len(self.memo) > MEMO_PARTS:  # what is used again comes back from the former half
            self.former, self.memo = self.memo, {}
        memo, former = self.memo, self.former
        found = list(map(memo.get, parts))
        if None in found:
            for k, own in enumerate(found):
                if own is None:
                    p = parts[k]
                    found[k] = memo[p] = former.get(p) or memo.get(p) or self._learn(p)
        return b"".join(found)


_ENCODERS: dict[str, _Encoder] = {}

TOKENS = "part int, queue string, before long, doc_id long, n long, ids binary"


def _tokens(tokenizer: str, end_id: int):
    """Ids of every document, with the tokens of its queue that the partition has before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, _Encoder(tokenizer))
        width, end = np.dtype(encoder.kind).itemsize, np.array([end_id], encoder.kind).tobytes()
        part, so_far = TaskContext.get().partitionId(), {}
        for b in slices(batches):
            queues = b.column("queue").to_pylist()
            ids = [encoder(t) + end for t in texts(b)]
            sizes = [len(x) // width for x in ids]
            before = []
            for q, n in zip(queues, sizes, strict=True):
                before.append(so_far.get(q, 0))
                so_far[q] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part), pa.int32()), b.column("queue"), pa.array(before, pa.int64()), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "queue", "before", "doc_id", "n", "ids"],
            )

    return run


class RoundRobin:
    """Which queue fills which part of which window.

    A queue's target is its weight's share of every token served while it
    lasts; when one ends, the others share what it leaves. At the start of a block
    of windows the tokens served are those with the least due times, ``k`` + 1/2
    tokens over the weight for a queue's token ``k``: within one token of the
    target, exact in integers and known without the blocks before. What target
    and served differ by is the deficit that a queue carries into the block,
    where each window adds a quantum in the block's proportions, takes the whole
    tokens and gives what is left to the largest deficits.

    The last block ends in windows of falling powers of two, so none is padded.
    """

    def __init__(self, totals: list[int], weights: list[int] | None = None, capacity: int = CAPACITY, windows: int = BLOCK_WINDOWS):
        self.totals, self.weights, self.capacity, self.windows = totals, weights or totals, capacity, windows
        self.tokens, self.block_tokens = sum(totals), capacity * windows
        self.blocks = -(-self.tokens // self.block_tokens)
        self.phases = [(Fraction(0), 0, sum(self.weights))]  # time, tokens served, tokens served in a unit of time from there
        for s in sorted(range(len(totals)), key=lambda s: Fraction(totals[s], self.weights[s])):
            time, served, rate = self.phases[-1]
            ends = Fraction(totals[s], self.weights[s])
            self.phases.append((ends, served + (ends - time) * rate, rate - self.weights[s]))
        self.served, self.block = lru_cache(4096)(self._served), lru_cache(max(64, 2 * len(totals)))(self._block)

    def time(self, tokens: int) -> Fraction:
        """When so many tokens are due in all."""
        time, served, rate = next(p for p in reversed(self.phases) if p[1] <= tokens)
        return time + (tokens - served) / Fraction(rate) if rate else time

    def _served(self, block: int) -> tuple[list[int], list[Fraction]]:
        """Tokens of each queue before a block, and its deficit there."""
        tokens = min(block * self.block_tokens, self.tokens)
        time, w = self.time(tokens), self.weights
        target = [min(Fraction(t), x * time) for t, x in zip(self.totals, w, strict=True)]
        c = [min(t, int(x + Fraction(1, 2))) for t, x in zip(self.totals, target, strict=True)]
        short = tokens - sum(c)
        if short > 0:
            due = [(Fraction(2 * c[s] + 1, w[s]), s) for s in range(len(c)) if c[s] < self.totals[s]]
            heapq.heapify(due)
            for _ in range(short):
                s = due[0][1]
                c[s] += 1
                if c[s] < self.totals[s]:
                    heapq.heapreplace(due, (Fraction(2 * c[s] + 1, w[s]), s))
                else:
                    heapq.heappop(due)
        elif short < 0:
            due = [(-Fraction(2 * c[s] - 1, w[s]), -s) for s in range(len(c)) if c[s]]
            heapq.heapify(due)
            for _ in range(-short):
                s = -due[0][1]
                c[s] -= 1
                if c[s]:
                    heapq.heapreplace(due, (-Fraction(2 * c[s] - 1, w[s]), -s))
                else:
                    heapq.heappop(due)
        return c, [a - b for a, b in zip(target, c, strict=True)]

    def _block(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block's windows (rows) and queues (columns): tokens served before each window and at the end, and where a queue begins in it."""
        (start, deficit), (end, _) = self.served(block), self.served(block + 1)
        left = np.array(end, np.int64) - np.array(start, np.int64)
        tokens = int(left.sum())
        rooms = [self.capacity] * (tokens // self.capacity) + [1 << k for k in range(self.capacity.bit_length() - 1, -1, -1) if tokens % self.capacity >> k & 1]
        quota, owed = left.copy(), np.array([int(d * tokens // 1) for d in deficit], np.int64)
        takes = np.zeros((len(rooms), len(left)), np.int64)
        for take, room in zip(takes, rooms, strict=True):
            owed += quota * room
            take[:] = np.minimum(np.maximum(owed, 0) // tokens, left)
            while (short := room - int(take.sum())) > 0:
                open_ = np.flatnonzero(left > take)
                first = open_[np.argsort(take[open_] * tokens - owed[open_], kind="stable")][:short]
                take[first] += np.minimum(left[first] - take[first], max(1, short // len(open_)))
            while (over := int(take.sum()) - room) > 0:
                some = np.flatnonzero(take)
                take[some[np.argsort(owed[some] - take[some] * tokens, kind="stable")][:over]] -= 1
            owed -= take * tokens
            left -= take
        before = np.concatenate((np.zeros((1, len(left)), np.int64), np.cumsum(takes, axis=0)))
        return before, np.cumsum(takes, axis=1) - takes, np.array(start, np.int64)

    def block_of(self, queue: int, token: int) -> int:
        """The block that serves a queue's token."""
        time, served, rate = next(p for p in reversed(self.phases) if p[0] <= Fraction(token, self.weights[queue]))
        block = min(int(served + (Fraction(token, self.weights[queue]) - time) * rate) // self.block_tokens, self.blocks - 1)
        while self.served(block)[0][queue] > token:
            block -= 1
        while self.served(block + 1)[0][queue] <= token:
            block += 1
        return block

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start among the n tokens, length, window, offset in it) of a queue's tokens ``first`` to ``first + n``."""
        block, done = self.block_of(queue, first), 0
        while done < n:
            before, begins, start = self.block(block)
            own, at = before[:, queue], first + done - int(start[queue])
            w = int(np.searchsorted(own, at, "right")) - 1
            while done < n and w < len(own) - 1:
                length = min(n - done, int(own[w + 1]) - at)
                if length:
                    yield done, length, block * self.windows + w, int(begins[w, queue]) + at - int(own[w])
                done, at, w = done + length, at + length, w + 1
            block += 1


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pieces(plan: tuple, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(*plan)
        for b in slices(batches):
            rows, ids = [], []
            for q, first, d, n, own in zip(*(b.column(c).to_pylist() for c in ("number", "first", "doc_id", "n", "ids")), strict=True):
                wide = np.frombuffer(own, kind).astype("<u4").tobytes()
                for start, length, window, offset in robin.pieces(q, first, n):
                    rows.append((d, start, length, n, window, offset))
                    ids.append(wide[4 * start : 4 * (start + length)])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            d, start, length, n, window, offset = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([d, start, length, pa.array(ids, pa.binary()), n, window, offset], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_mixture(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str | None, int] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents of ``docs`` (doc_id, text, source) in windows of ``capacity`` tokens (a power of two).

    A document is its ids and ``end_id``. Documents of a source queue up in the
    order of the table's partitions. Each window takes from the queues by deficit
    round-robin (see ``RoundRobin``) in the proportions of ``weights`` (positive; 1 for
    a source not named), by default in those of the queues' tokens, so that all end
    together. Every id lies in one piece, pieces fill their window without gaps,
    and only the last few windows are shorter, at powers of two. ``ids`` has a
    piece's ids as little-endian 32-bit numbers.

    Texts are encoded once, where they are read; ids never move but with a join
    of queue starts that is too large to broadcast (one row for each partition
    and source). More than ``MOST_QUEUES`` sources share that many queues by a hash of
    their names. Null is a source; null and empty texts have ``end_id`` alone; repeated
    rows are documents of their own; an empty table gives no pieces; other columns are
    not read.
    """
    if capacity & (capacity - 1):
        raise ValueError("a window's capacity is a power of two")
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), queue.alias("queue"))
    tokens = written(view.mapInArrow(_tokens(tokenizer, end_id), TOKENS))
    sums = written(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    names = sums.select("queue").distinct()
    shared = names.count() > MOST_QUEUES
    key = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(MOST_QUEUES)).cast("string")) if shared else F.col("queue")
    sums = sums.withColumn("key", key)
    queues = sorted(sums.groupBy("key").agg(F.sum("n").alias("n")).collect())
    number = tokens.sparkSession.createDataFrame([(q.key, k) for k, q in enumerate(queues)], "key string, number int")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("ahead", ahead).join(F.broadcast(number), "key").select("part", "queue", "number", "ahead")
    if sums.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, ["part", "queue"]).select("number", (F.col("ahead") + F.col("before")).alias("first"), "doc_id", "n", "ids")
    named = None if weights is None or shared else [int(weights.get(q.key[1:] if q.key else None, 1)) for q in queues]
    if named and min(named) < 1:
        raise ValueError("weights are positive")
    kind = "<u2" if byte_bpe(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    return placed.mapInArrow(_pieces(([q.n for q in queues], named, capacity, BLOCK_WINDOWS), kind), PIECES)
