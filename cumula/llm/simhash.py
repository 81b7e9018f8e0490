"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import durable, shuffle_width, texts
from cumula.llm.components import connected_components

SHINGLE, SEED, RADIUS, TILE_ROWS, STRIP = 3, 42, 3, 32_768, 1 << 18


def hashed_shingles(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of all shingles in order; ASCII letters lower-cased, words cut at ASCII white space.

    Fewer words than a shingle hash as one, no word gives none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's shingles, repeats included; no word gives zero."""
    return majority(hashed_shingles(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    view = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return view.mapInArrow(run, "doc_id long, fp long")


def local_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _parts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, strip by strip, exactly.

    ``left`` is cut into sub-tiles of equal population counts; rows of ``right``
    whose counts differ by more than the radius in sum cannot be close.
    """
    pl, pr = _parts(left), _parts(right)
    kinds, which = np.unique(pl, axis=0, return_inverse=True)
    order, bounds = np.argsort(which, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))))
    for k, kind in enumerate(kinds):
        rows, cols = order[bounds[k] : bounds[k + 1]], np.flatnonzero(np.abs(pr - kind).sum(1) <= radius)
        if not len(cols):
            continue
        other, step = right[cols], max(1, STRIP // len(cols))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(left[own][:, None] ^ other[None, :]) <= radius)
            if len(i):
                yield own[i], cols[j]


def _tile_links(radius: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        is_left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        left, right = fp[is_left], fp[~is_left]
        nodes, tries = np.concatenate((left, right)), []
        if key[2].as_py() == key[3].as_py():
            tries.append((left, 0))
        if len(right):
            tries.append((right, len(left)))
        label, us, vs, held = np.arange(len(nodes)), [], [], 0
        for other, shift in tries:
            for i, j in close_pairs(left, other, radius):
                us.append(i)
                vs.append(j + shift)
                held += len(i)
                if held > 1 << 20:  # keep a forest, not all links
                    label = local_forest(len(nodes), np.concatenate([np.arange(len(nodes)), *us]), np.concatenate([label, *vs]))
                    us, vs, held = [], [], 0
        label = local_forest(len(nodes), np.concatenate([np.arange(len(nodes)), *us]), np.concatenate([label, *vs]))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[moved].view(np.int64)), "v": pa.array(nodes[label[moved]].view(np.int64))})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints at most ``radius`` bits apart.

    A tile holds the fingerprints with the same population counts in both
    32-bit halves. Counts that differ by more than the radius in sum skip the
    tile pair; every other pair is compared in full by exclusive-or and bit
    counts. Tiles over ``tile_rows`` are cut into chunks, so that a task's rows
    stay bounded. A task returns a spanning forest of what it found, so a dense
    group costs its size and not its square.
    """
    spark = nodes.sparkSession
    halves = nodes.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("lo"))
    sizes = {(r.hi, r.lo): r["n"] for r in halves.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 x 33 rows at most
    chunks = {t: -(-n // tile_rows) for t, n in sizes.items()}
    later = {t: [(t[0] + a, t[1] + b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a, b) > (0, 0) and abs(a) + abs(b) <= radius and (t[0] + a, t[1] + b) in chunks] for t in chunks}
    routes = []
    for t, k in chunks.items():
        routes.append((*t, *t, k, k, max([k, *(chunks[o] for o in later[t])])))
        routes += [(*o, *t, chunks[o], k, 0) for o in later[t]]
    if not routes:
        return spark.createDataFrame([], "u long, v long")
    route = spark.createDataFrame(routes, "hi int, lo int, t_hi int, t_lo int, k int, t_k int, rounds int")
    sent = halves.join(F.broadcast(route), ["hi", "lo"])  # 33 x 33 x 13 routes at most
    chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    own = sent.where("rounds > 0").select("fp", "t_hi", "t_lo", chunk.alias("c"), "t_k", "rounds")
    as_left = own.select("fp", "t_hi", "t_lo", F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("b"), F.lit(True).alias("left"))
    same = own.where("c > 0").select("fp", "t_hi", "t_lo", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("a"), F.col("c").alias("b"), F.lit(False).alias("left"))
    other = sent.where("rounds = 0").select("fp", "t_hi", "t_lo", F.explode(F.sequence(F.lit(0), F.col("t_k") - 1)).alias("a"), chunk.alias("b"), F.lit(False).alias("left"))
    copies = as_left.union(same).union(other)
    return copies.groupBy("t_hi", "t_lo", "a", "b").applyInArrow(_tile_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of ``radius`` bits or
    fewer. Null and empty texts have fingerprint zero and link like any other;
    repeated rows stay rows; rows without an id have their component's least
    id. Only ids and fingerprints are shuffled, and equal fingerprints are
    folded before any comparison.
    """
    fps = durable(fingerprints(docs, doc_id, text, shingle))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
