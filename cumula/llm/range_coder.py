"""Adaptive context-mixing range coder for token ids, many independent blocks at a time.

Every block of ids starts from the same state and ends with its own checksum, so
blocks can be coded side by side: each step codes one id of all blocks with
numpy. Three predictions are mixed into one distribution of the next id:

* order 2: the last four followers of the two ids before, by their counts,
* order 1: the last four followers of the id before, by their counts,
* order 0: counts of the ids that these did not foretell.

A follower's share is weight2 * share among the order-2 followers + weight1 *
share among the order-1 followers; what is left over codes an id by order 0. The
weights depend on how often both contexts were seen and adapt in each block:
after every id they move towards the part each order had in coding it. A payload
starts with the ids it holds, the commonest first; order 0 starts from counts
that fall with an id's place there, and takes up a block's own ids at steps 16,
32, 64 and so on, and from 256 on every 256 steps.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np

#: Ids in a block at most and at least, blocks to be coded side by side, and the most numbers that order 0 may hold.
BLOCK, LEAST_BLOCK, LANES, ROOM, MAGIC = 8192, 2048, 1024, 1 << 24, b"CMR3"
FRONT, HEAD = struct.Struct("<4sIII"), struct.Struct("<4sIII")
FULL, LEAST, WORD = 1 << 48, 1 << 32, 16
#: Scale of a mixed distribution; followers of a context; slots of the two context tables; speed of the weights.
TOTAL, KEPT, SLOTS1, SLOTS2, SPEED = 1 << 16, 4, 2048, 4096, 5
#: What an id adds to its order-0 count, the sum of all counts at the start, and the most steps between two updates.
STEP, START, EVERY = 32, 1 << 14, 256
#: A context's class by the sum of its counts.
_CLASS = np.searchsorted([1, 2, 4, 7, 12, 24, 60], np.arange(1021), "right").astype(np.int64)
#: By which follower is hit (bit k of the index; none: the oldest goes): the parts of a slot that move up and that stay, and where its count lies.
_HIT = [next((k for k in range(KEPT) if code >> k & 1), KEPT - 1) for code in range(1 << KEPT)]
_LOW16, _HIGH16 = (np.array([(1 << 16 * (k + more)) - 1 ^ flip for k in _HIT], np.uint64) for more, flip in ((0, 0), (1, (1 << 64) - 1)))
_LOW8, _HIGH8 = (np.array([(1 << 8 * (k + more)) - 1 ^ flip for k in _HIT], np.uint32) for more, flip in ((0, 0), (1, (1 << 32) - 1)))
_SHIFT, _KEEP, _ADD = np.array([8 * k for k in _HIT], np.uint32), np.array([255 * (code > 0) for code in range(1 << KEPT)], np.uint32), np.array([1 + (code > 0) for code in range(1 << KEPT)], np.uint32)


def block_of(count: int) -> int:
    """Ids in each block of a payload of so many ids."""
    return min(BLOCK, max(LEAST_BLOCK, -(-count // LANES)))


class _Counts:
    """Order-0 counts of n blocks over places 0 to k - 1, as sums up to each place."""

    def __init__(self, n: int, k: int):
        first = START // (np.arange(k) + 8) + 1
        self.counts = np.tile(first.astype(np.int32), (n, 1))
        self.offset, self.k, self.new = np.arange(n, dtype=np.int64)[:, None] << 32, k, []
        self._sum()

    def _sum(self) -> None:
        self.sums = np.cumsum(self.counts, axis=1, dtype=np.int64, out=getattr(self, "sums", None))
        self.sums += self.offset
        self.ends = self.sums.reshape(-1)  # ascending over all blocks
        self.total = self.ends[self.k - 1 :: self.k] & 0xFFFFFFFF

    def share(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of a place in the blocks ``at``."""
        spot = at * self.k + place
        width = self.counts.reshape(-1).take(spot).astype(np.int64)
        return (self.ends.take(spot) & 0xFFFFFFFF) - width, width

    def find(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place whose share holds a value."""
        return np.minimum(np.searchsorted(self.ends, (at << 32) + value, "right") - at * self.k, self.k - 1)

    def learn(self, step: int, at: np.ndarray, place: np.ndarray) -> None:
        self.new.append(at * self.k + place)
        step += 1
        if step % EVERY == 0 or (step < EVERY and step >= 16 and not step & step - 1):
            np.add.at(self.counts.reshape(-1), np.concatenate(self.new), STEP)
            self.new = []
            self._sum()


class _Followers:
    """The last followers of each slot, newest first, with their counts, in n blocks."""

    def __init__(self, n: int, slots: int):
        self.ids, self.counts = np.zeros(n * slots, np.uint64), np.zeros(n * slots, np.uint32)
        self.rows, self.slots = np.arange(n, dtype=np.int64) * slots, slots

    def look(self, mixed: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Fill ``ids`` and ``counts`` (a row for each follower) for the slots named by ``mixed``."""
        m = len(mixed)
        self.at = self.rows[:m] + (mixed & self.slots - 1)
        self.p, self.c = self.ids.take(self.at), self.counts.take(self.at)
        ids[:] = self.p.view(np.uint16).reshape(m, KEPT).T
        counts[:] = self.c.view(np.uint8).reshape(m, KEPT).T

    def learn(self, own: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Move ``own`` to the front; the oldest follower goes where it is new. Returns its count before."""
        e = equal.view(np.uint8)
        code = e[0] | e[1] << 1 | e[2] << 2 | e[3] << 3
        count = self.c >> _SHIFT.take(code) & _KEEP.take(code)
        self.ids[self.at] = self.p & _HIGH16.take(code) | (self.p & _LOW16.take(code)) << np.uint64(16) | own
        self.counts[self.at] = self.c & _HIGH8.take(code) | (self.c & _LOW8.take(code)) << np.uint32(8) | np.minimum(count + _ADD.take(code), 255)
        return count


class _Model:
    """State of n blocks."""

    def __init__(self, n: int):
        self.two, self.one = _Followers(n, SLOTS2), _Followers(n, SLOTS1)
        self.w2, self.w1 = (np.full(n * 64, TOTAL // 3, np.int32) for _ in range(2))
        self.rows64, self.p1, self.p2 = np.arange(n, dtype=np.int64) * 64, np.zeros(n, np.int64), np.zeros(n, np.int64)

    def look(self, m: int) -> None:
        """Candidates for the next id of the first m blocks and the cumulative shares of them."""
        h1 = self.p1[:m] * 2654435761
        self.cand, self.n = np.empty((2 * KEPT, m), np.uint16), np.empty((2 * KEPT, m), np.int32)
        self.two.look(h1 + self.p2[:m] * 40503 * 65599 >> 13, self.cand[:KEPT], self.n[:KEPT])
        self.one.look(h1 >> 9, self.cand[KEPT:], self.n[KEPT:])
        t2, t1 = self.n[:KEPT].sum(0), self.n[KEPT:].sum(0)
        self.ctx = self.rows64[:m] + _CLASS.take(t2) * 8 + _CLASS.take(t1)
        self.v2, self.v1 = self.w2.take(self.ctx), self.w1.take(self.ctx)
        self.unit2, self.unit1 = self.v2 // np.maximum(t2, 1), self.v1 // np.maximum(t1, 1)
        self.known = self.n > 0
        self.mass = self.n
        self.mass[:KEPT] *= self.unit2
        self.mass[KEPT:] *= self.unit1
        for k in range(KEPT, 2 * KEPT):  # a follower in both contexts has one share
            twin = self.cand[:KEPT] == self.cand[k]
            twin &= self.known[:KEPT]
            self.mass[:KEPT] += twin * self.mass[k]
            self.mass[k] *= ~twin.any(0)
        self.ends = self.mass.cumsum(0, dtype=np.int32)

    def equals(self, own: np.ndarray) -> np.ndarray:
        self.equal = (self.cand == own.astype(np.uint16)) & self.known
        return self.equal

    def learn(self, m: int, own: np.ndarray) -> None:
        wide = own.astype(np.uint64)
        m2 = self.two.learn(wide, self.equal[:KEPT]) * self.unit2
        m1 = self.one.learn(wide, self.equal[KEPT:]) * self.unit1
        part = (TOTAL - 1024.0) / np.maximum(m2 + m1, 1)
        self.w2[self.ctx] = self.v2 + (((m2 * part).astype(np.int32) - self.v2) >> SPEED)
        self.w1[self.ctx] = self.v1 + (((m1 * part).astype(np.int32) - self.v1) >> SPEED)
        self.p2[:m] = self.p1[:m]
        self.p1[:m] = own


class _Writer:
    def __init__(self, n: int, ids: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, FULL - 1, np.int64)
        self.words, self.count = np.zeros((n, ids * 3 + 8), np.int32), np.zeros(n, np.int64)

    def settle(self, at: np.ndarray | None, low: np.ndarray, rng: np.ndarray) -> None:
        """Move full words out of ``low`` of the blocks ``at`` (None: the first), in place."""
        small = np.flatnonzero(rng < LEAST)
        while len(small):
            own = small if at is None else at[small]
            count, left = self.count[own], low[small]
            self.words[own, count] = left >> 32  # may hold a carry, settled at the end
            self.count[own] = count + 1
            low[small] = (left & 0xFFFFFFFF) << WORD
            grown = rng[small] << WORD
            rng[small] = grown
            small = small[grown < LEAST]

    def finish(self) -> list[bytes]:
        own = np.arange(len(self.low))
        for _ in range(3):
            self.words[own, self.count] = self.low >> 32
            self.count += 1
            self.low = (self.low & 0xFFFFFFFF) << WORD
        for k in range(int(self.count.max(initial=0)) - 1, 0, -1):
            self.words[:, k - 1] += self.words[:, k] >> 16
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.words, self.count, strict=True)]


class _Reader:
    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        self.words = np.zeros((n, max(map(len, words), default=0) + 8), np.int64)
        for row, w in zip(self.words, words, strict=True):
            row[: len(w)] = w
        self.code = self.words[:, 0] << 32 | self.words[:, 1] << 16 | self.words[:, 2]
        self.range, self.at = np.full(n, FULL - 1, np.int64), np.full(n, 3, np.int64)

    def settle(self, at: np.ndarray | None, code: np.ndarray, rng: np.ndarray) -> None:
        """Take further words into ``code`` of the blocks ``at`` (None: the first), in place."""
        small = np.flatnonzero(rng < LEAST)
        while len(small):
            own = small if at is None else at[small]
            place = self.at[own]
            code[small] = code[small] << WORD | self.words[own, np.minimum(place, self.words.shape[1] - 1)]
            self.at[own] = place + 1
            grown = rng[small] << WORD
            rng[small] = grown
            small = small[grown < LEAST]


def encode(ids: np.ndarray) -> bytes:
    """The ids' own alphabet and blocks of ids (below 65,536), each with its mark, counts and checksum."""
    ids = np.ascontiguousarray(ids, np.int32)
    if not len(ids):
        return b""
    if ids.min() < 0 or ids.max() > 0xFFFF:
        raise ValueError("ids must lie in 0 to 65535")
    often = np.bincount(ids, minlength=1 << 16)
    alphabet = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    places = np.zeros(1 << 16, np.int32)
    places[alphabet] = np.arange(len(alphabet))
    packed = []
    block = block_of(len(ids))
    group = max(1, ROOM // len(alphabet)) * block  # so many blocks are coded side by side
    for at in range(0, len(ids), group):
        packed += _encode_blocks(ids[at : at + group], places, len(alphabet), block)
    letters = alphabet.astype("<u2").tobytes()
    return b"".join([FRONT.pack(MAGIC, block, len(alphabet), crc32(letters)), letters, *packed])


def _encode_blocks(ids: np.ndarray, places: np.ndarray, k: int, block: int) -> list[bytes]:
    n = -(-len(ids) // block)
    last, steps = len(ids) - (n - 1) * block, min(len(ids), block)
    table = np.zeros(n * block, np.int32)
    table[: len(ids)] = places.take(ids)
    table = np.ascontiguousarray(table.reshape(n, block)[:, :steps].T)
    model, counts, out = _Model(n), _Counts(n, k), _Writer(n, steps)
    for t in range(steps):
        m = n if t < last else n - 1
        own = table[t, :m]
        model.look(m)
        hit = model.equals(own) & (model.mass > 0)
        any_hit, rest = hit.any(0), model.ends[-1]
        width = (model.mass * hit).sum(0)
        low, rng = out.low[:m], out.range[:m]
        share = rng // TOTAL
        low += share * np.where(any_hit, (model.ends * hit).sum(0) - width, rest)
        rng[:] = share * np.where(any_hit, width, TOTAL - rest)
        out.settle(None, low, rng)
        miss = np.flatnonzero(~any_hit)
        place = own.take(miss)
        begin, wide = counts.share(miss, place)
        share = rng[miss] // counts.total.take(miss)
        lo, ra = low[miss] + share * begin, share * wide
        out.settle(miss, lo, ra)
        low[miss], rng[miss] = lo, ra
        counts.learn(t, miss, place)
        model.learn(m, own)
    packed = []
    for i, w in enumerate(out.finish()):
        part = ids[i * block : (i + 1) * block]
        packed += [HEAD.pack(b"BLCK", len(part), len(w) // 2, crc32(part.astype("<u4").tobytes())), w]
    return packed


def _blocks(data: bytes) -> tuple[np.ndarray, int, list[int], list[np.ndarray], list[int]]:
    counts, words, sums = [], [], []
    if len(data) < FRONT.size:
        raise ValueError("the front is cut off")
    magic, block, k, check = FRONT.unpack_from(data)
    at = FRONT.size + 2 * k
    if magic != MAGIC or not 0 < block <= BLOCK or not 0 < k <= 1 << 16 or at > len(data) or crc32(data[FRONT.size : at]) != check:
        raise ValueError("not a payload")
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("a block's head is cut off")
        magic, ids, length, check = HEAD.unpack_from(data, at)
        at += HEAD.size
        if magic != b"BLCK" or at + 2 * length > len(data) or not 0 < ids <= block or not 3 <= length <= 3 * ids + 8 or (counts and counts[-1] != block):
            raise ValueError("not a block")
        words.append(np.frombuffer(data, "<u2", length, at))
        counts.append(ids)
        sums.append(check)
        at += 2 * length
    return np.frombuffer(data, "<u2", k, FRONT.size).astype(np.int32), block, counts, words, sums


def decode(data: bytes) -> np.ndarray:
    """The ids again; raises ValueError where a mark, a length or a block's checksum is wrong."""
    if not data:
        return np.zeros(0, np.int32)
    alphabet, block, counts, words, sums = _blocks(data)
    group = max(1, ROOM // len(alphabet))
    flat = np.concatenate([_decode_blocks(counts[at : at + group], words[at : at + group], alphabet) for at in range(0, len(counts), group)])
    for k, check in enumerate(sums):
        if crc32(flat[k * block : k * block + counts[k]].astype("<u4").tobytes()) != check:
            raise ValueError(f"block {k}: wrong checksum")
    return flat


def _decode_blocks(sizes: list[int], words: list[np.ndarray], alphabet: np.ndarray) -> np.ndarray:
    n, last, steps = len(sizes), sizes[-1], sizes[0]
    model, counts, src, table = _Model(n), _Counts(n, len(alphabet)), _Reader(words), np.zeros((steps, n), np.int32)
    for t in range(steps):
        m = n if t < last else n - 1
        model.look(m)
        rest, lane, code, rng = model.ends[-1], np.arange(m), src.code[:m], src.range[:m]
        share = rng // TOTAL
        spot = np.minimum(code // share, TOTAL - 1)
        k = np.minimum((model.ends <= spot).sum(0), 2 * KEPT - 1)
        missed = spot >= rest
        own, width = model.cand[k, lane].astype(np.int32), model.mass[k, lane]
        code -= share * np.where(missed, rest, model.ends[k, lane] - width)
        rng[:] = share * np.where(missed, TOTAL - rest, width)
        src.settle(None, code, rng)
        miss = np.flatnonzero(missed)
        total = counts.total.take(miss)
        share = rng[miss] // total
        place = counts.find(miss, np.minimum(code[miss] // share, total - 1))
        begin, wide = counts.share(miss, place)
        co, ra = code[miss] - share * begin, share * wide
        src.settle(miss, co, ra)
        code[miss], rng[miss], own[miss] = co, ra, place
        counts.learn(t, miss, place)
        table[t, :m] = own
        model.equals(own)
        model.learn(m, own)
    return alphabet.take(np.minimum(np.concatenate([table[:c, k] for k, c in enumerate(sizes)]), len(alphabet) - 1))
