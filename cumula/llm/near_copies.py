"""Near copies: wide SimHash fingerprints compared in tiles of all texts, what is close verified by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import documents_view, durable, slices, texts
from cumula.llm.components import connected_components
from cumula.llm.simhash import STRIP, hashed_shingles, local_forest, majority

#: Two texts are near copies if they share so much of all their five-word shingles.
SHINGLE, PART, WHOLE, SEED = 5, 4, 5, 42
#: 64-bit words of a fingerprint, and bits in which those of near copies may differ: 48 of 256 are expected at worst
#: (four shingles and five), more than 80 have a probability of 5.5e-7; unrelated texts differ in 80 or fewer with 1e-9.
WORDS, RADIUS = 4, 80
#: Sizes of near copies lie in the same or the next class, as this base is above 5/4; classes of population counts of a half.
SIZE_BASE, COUNT_STEP = 1.26, 16
#: Fingerprints in one side of a tile of the comparison; texts and bytes of shingle hashes in one of the verification.
TILE_ROWS, TILE_TEXTS, TILE_BYTES = 8192, 1024, 4 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words as in ``simhash.fingerprint``."""
    return np.unique(hashed_shingles(text, shingle))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WORDS times 64 bits: the first word by the hashes, the others by mixes of them."""
    words = [majority(hashes)]
    for k in range(1, WORDS):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(majority(x ^ (x >> np.uint64(31))))
    return np.array(words, np.uint64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _nodes(view: DataFrame) -> DataFrame:
    """(doc_id, t, node, n, fp): a hash of the text, one of the shingle set, its size and its packed fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in texts(b)]
            fps = [wide_fingerprint(h).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(fps, pa.binary())],
                names=["doc_id", "t", "node", "n", "fp"],
            )

    return view.mapInArrow(run, "doc_id long, t long, node long, n long, fp binary")


def _tiled(nodes: DataFrame) -> DataFrame:
    """(node, n, fp, size, hi, lo): classes of the size and of the population counts of both halves.

    Sets of fewer than four shingles are near copies of equal sets only, which are folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ones = np.bitwise_count(_unpacked(b.column("fp"))).astype(np.int32)
            hi, lo = (ones[:, k : k + WORDS // 2].sum(1, dtype=np.int32) // COUNT_STEP for k in (0, WORDS // 2))
            size = np.floor(np.log(b.column("n").to_numpy()) / np.log(SIZE_BASE)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(hi, pa.int32()), pa.array(lo, pa.int32())], names=["node", "n", "fp", "size", "hi", "lo"])

    return nodes.where(F.col("n") >= PART).select("node", "n", "fp").mapInArrow(run, "node long, n long, fp binary, size int, hi int, lo int")


def _unpacked(fps: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, WORDS)


def _gap(a: int, b: int) -> int:
    """Least difference of two population counts by their classes."""
    return max(0, (abs(a - b) - 1) * COUNT_STEP + 1)


def close_wide(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of wide fingerprints within the radius, strip by strip, exactly.

    Rows go by population count, and a strip skips those of ``right`` whose
    counts differ by more than the radius.
    """
    if not len(left) or not len(right):
        return
    ones, others = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left, right))
    rows, cols = np.argsort(ones, kind="stable"), np.argsort(others, kind="stable")
    ones, others, step = ones[rows], others[cols], max(1, STRIP // len(cols))
    own, other = np.ascontiguousarray(left[rows].T), np.ascontiguousarray(right[cols].T)
    for at in range(0, len(rows), step):
        end = min(at + step, len(rows))
        lo, hi = np.searchsorted(others, ones[at] - radius), np.searchsorted(others, ones[end - 1] + radius, "right")
        apart = np.zeros((end - at, hi - lo), np.uint16)
        for w in range(WORDS):
            apart += np.bitwise_count(own[w, at:end, None] ^ other[w, None, lo:hi])
        i, j = np.nonzero(apart <= radius)
        if len(i):
            yield rows[at + i], cols[lo + j]


def _close_tile(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A spanning forest of the pairs of a tile within the radius whose sizes allow the similarity."""
    nodes, n, fps = group.column("node").to_numpy(), group.column("n").to_numpy(), _unpacked(group.column("fp"))
    is_left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
    one, two = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    label, us, vs, held = np.arange(len(nodes)), [], [], 0

    def forest() -> np.ndarray:
        return local_forest(len(nodes), np.concatenate([np.arange(len(nodes)), *us]), np.concatenate([label, *vs]))

    for side in ([one, two] if key[1].as_py() == key[2].as_py() else [two]):
        for i, j in close_wide(fps[one], fps[side], RADIUS):
            i, j = one[i], side[j]
            fit = (i != j) & (WHOLE * np.minimum(n[i], n[j]) >= PART * np.maximum(n[i], n[j]))
            us.append(i[fit])
            vs.append(j[fit])
            held += len(us[-1])
            if held > 1 << 20:  # keep a forest, not all links
                label, us, vs, held = forest(), [], [], 0
    label = forest()
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[moved]), "v": pa.array(nodes[label[moved]])})


def close_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets (node, n, fp) whose fingerprints differ in at most RADIUS bits.

    As in ``simhash.links``, a tile holds the fingerprints of like population
    counts in both halves, here also of like size; pairs of tiles whose counts
    lie beyond the radius, or whose sizes rule the similarity out, are skipped,
    and every other pair is compared in full. Tiles over TILE_ROWS are cut into
    chunks, so that a task's rows stay bounded. Comparisons grow with the
    square of the texts of like size.
    """
    tiled = durable(_tiled(nodes))
    kind = ["size", "hi", "lo"]
    counts = {(r.size, r.hi, r.lo): r["rows"] for r in tiled.groupBy(*kind).agg(F.count("*").alias("rows")).collect()}  # at most 9 x 9 for each size class
    chunks = {t: -(-rows // TILE_ROWS) for t, rows in sorted(counts.items())}
    routes = []
    for number, (t, k) in enumerate(chunks.items()):
        later = [o for o in chunks if o > t and o[0] - t[0] <= 1 and _gap(o[1], t[1]) + _gap(o[2], t[2]) <= RADIUS]
        routes.append((*t, number, k, k, max([k, *(chunks[o] for o in later)])))
        routes += [(*o, number, chunks[o], k, 0) for o in later]
    if not routes:
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    route = nodes.sparkSession.createDataFrame(routes, "size int, hi int, lo int, tile int, k int, t_k int, rounds int")
    sent = tiled.join(F.broadcast(route), kind).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rest = ["node", "n", "fp", "tile"]

    def upto(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    as_left = sent.where("rounds > 0").select(*rest, F.col("c").alias("a"), upto(F.col("rounds")).alias("b"), F.lit(True).alias("left"))
    same = sent.where("rounds > 0 and c > 0").select(*rest, upto(F.col("c")).alias("a"), F.col("c").alias("b"), F.lit(False).alias("left"))
    other = sent.where("rounds = 0").select(*rest, upto(F.col("t_k")).alias("a"), F.col("c").alias("b"), F.lit(False).alias("left"))
    return as_left.union(same).union(other).groupBy("tile", "a", "b").applyInArrow(_close_tile, "u long, v long")


def _sets(view: DataFrame) -> DataFrame:
    """(node, hashes) of every text: the hashes of its shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    return view.select("text").mapInArrow(run, "node long, hashes binary")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (left, right) whose sets reach the similarity.

    The shingles of ``right`` are indexed, so a row costs what it shares with others.
    """
    owner = np.repeat(np.arange(len(right)), [len(h) for h in right])
    flat = np.concatenate([*right, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    known, begin, count = np.unique(flat[order], return_index=True, return_counts=True)
    owner, sizes, us, vs = owner[order], np.array([len(h) for h in right]), [], []
    for i in range(len(left) if len(known) else 0):
        at = np.minimum(np.searchsorted(known, left[i]), len(known) - 1)
        at = at[known[at] == left[i]]
        n = count[at]
        places = np.arange(n.sum()) + np.repeat(begin[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(at) else np.zeros(0, np.int64)
        common = np.bincount(owner[places], minlength=len(right))
        j = np.flatnonzero(WHOLE * common >= PART * (len(left[i]) + sizes - common))
        us.append(np.full(len(j), i))
        vs.append(j)
    return np.concatenate([*us, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*vs, np.zeros(0, np.int64)]).astype(np.int64)


def _compare_tile(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A spanning forest of the similar pairs of a tile."""
    # A text may be in several small buckets of one tile; its first row counts. The hashes stay in the group's own buffers.
    node = group.column("node").to_numpy()
    _, keep = np.unique(node, return_index=True)
    nodes = node[keep]
    is_left = group.column("left").to_numpy(zero_copy_only=False)[keep].astype(bool)
    packed = group.column("hashes").combine_chunks()
    sets = [np.frombuffer(packed[int(k)].as_buffer(), np.uint64) for k in keep]
    one = np.flatnonzero(is_left)
    two = one if is_left.all() else np.flatnonzero(~is_left)
    i, j = similar_pairs([sets[k] for k in one], [sets[k] for k in two])
    label = local_forest(len(nodes), one[i], two[j])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[moved]), "v": pa.array(nodes[label[moved]])})


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that connect all similar texts of a bucket; ``members`` has node, bucket, texts and bytes of the bucket.

    A bucket beyond the bound of a tile is cut into chunks, and each pair of
    chunks is a tile; smaller buckets share tiles. So a task's rows stay bounded
    and every pair of a bucket is compared.
    """
    whole = F.greatest(F.ceil(F.col("texts") / TILE_TEXTS), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    sized = members.withColumn("k", whole)
    small = sized.where("k = 1").agg(F.count("*"), F.sum(8 * F.col("n"))).first()
    tiles = max(1, -(-small[0] // TILE_TEXTS), -(-(small[1] or 0) // TILE_BYTES))
    little = sized.where("k = 1").select("node", F.pmod(F.xxhash64("bucket"), F.lit(tiles)).alias("tile"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(True).alias("left"))
    chunk, other = F.pmod(F.xxhash64("node"), F.col("k")).cast("int"), F.col("o")
    spread = sized.where("k > 1").select("node", "bucket", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    large = spread.select("node", F.col("bucket").alias("tile"), F.least("c", other).alias("a"), F.greatest("c", other).alias("b"), (F.col("c") <= other).alias("left"))
    sent = little.distinct().union(large).join(sets, "node")
    return sent.groupBy("tile", "a", "b").applyInArrow(_compare_tile, "u long, v long")


def _members(nodes: DataFrame) -> DataFrame:
    """(node, n, bucket, texts, bytes) of every text with another within the radius; a bucket is a component of such pairs."""
    rows = durable(nodes.join(connected_components(close_links(nodes)), "node").select("node", "n", F.col("root").alias("bucket")))
    size = rows.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum(8 * F.col("n")).alias("bytes"))
    return durable(rows.join(size, "bucket"))


def _grouped(view: DataFrame) -> DataFrame:
    """(doc_id, t, first) of every row of (doc_id, text, t): the least (doc_id, t) of its group."""
    named = durable(_nodes(view))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))
    nodes = durable(named.groupBy("node").agg(F.min(own).alias("least"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    members = _members(nodes)
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("t")
    sets = durable(_sets(view.join(wanted, "t", "left_semi")).dropDuplicates(["node"]))
    roots = connected_components(links(members, sets))
    whole = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("first"))
    return named.select("doc_id", "t", "node").join(whole.select("node", "root").join(least, "root").select("node", "first"), "node").select("doc_id", "t", "first")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over pairs of texts whose sets
    of five-word shingles have a Jaccard similarity of 4/5 or more. Equal sets
    are folded first, so texts without words are one group. SimHash
    fingerprints of all texts meet in tiles of like population counts and sizes
    and are compared by exclusive-or and bit counts; what hangs together within
    the radius is verified on the whole sets. Only texts within the radius of
    another travel as sets. Rows without an id have their group's least id; an
    empty table gives an empty result.
    """
    view = documents_view(docs, doc_id, text).withColumn("t", _text_hash(F.col("text")))
    return _grouped(view).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the least id, ties by a hash of the text.

    Rows equal in both stay once, by the least JSON of the row; rows without an
    id are kept.
    """
    row = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _text_hash(F.col(f"`{text}`")).alias("t"))
    view = documents_view(docs, doc_id, text).withColumn("t", _text_hash(F.col("text")))
    first = _grouped(view).where("first is not null").select("first.doc_id", "first.t").distinct()
    kept = row.where("doc_id is not null").join(first, ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row").union(row.where("doc_id is null").select("row")).select("row.*")
