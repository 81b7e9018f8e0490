"""Best-fit packing of documents into sequences, with conflicts between documents."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import durable

#: Units of a sequence, and pieces that are packed against each other at once, on average.
CAPACITY, BLOCK_PIECES = 8192, 4096


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level model: the bytes of the text and an end token."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_cluster(text: Column) -> Column:
    """Class of texts that are equal but for letter case and white space; null for texts without words."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.btrim(bare) != "", F.xxhash64(F.btrim(bare)))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; the longest are placed first, ties by position.

    Open bins are kept in order of the room left and carry a bitmap of sources
    and one of clusters. A piece goes to the tightest bin that has room and
    neither its source nor its cluster; the search goes from each bin to its
    successor until one fits, else a new bin opens. A null source or cluster
    conflicts with nothing. Only clusters with two pieces or more get a bit.
    """
    bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    several = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]
    twin = {c: 1 << i for i, c in enumerate(several)}
    open_bins: list[tuple[int, int]] = []  # room, bin
    source_bits, cluster_bits, used = [], [], []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for p in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, s, c = lengths[p], bit.get(sources[p], 0), twin.get(clusters[p], 0)
        for k in range(bisect_left(open_bins, (need, -1)), len(open_bins)):
            b = open_bins[k][1]
            if not (source_bits[b] & s or cluster_bits[b] & c):
                del open_bins[k]
                break
        else:
            b = len(used)
            source_bits.append(0)
            cluster_bits.append(0)
            used.append(0)
        bins[p], offsets[p] = b, used[b]
        source_bits[b] |= s
        cluster_bits[b] |= c
        used[b] += need
        if used[b] < capacity:
            insort(open_bins, (capacity - used[b], b))
    return bins, offsets


PACKED = "doc_id long, piece int, bin_id string, bin_offset long, unit_begin long, unit_end long, bin_units long"


def _pack_block(capacity: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        # Equal keys belong to interchangeable rows, so the order does not depend on how the block came together.
        group = group.sort_by([(c, "ascending") for c in ("units", "doc_id", "piece", "source", "cluster", "unit_begin", "copy")])
        length = group.column("units").to_pylist()
        bins, offsets = best_fit(length, group.column("source").to_pylist(), group.column("cluster").to_pylist(), capacity)
        room = Counter()
        for b, n in zip(bins, length, strict=True):
            room[b] += n
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "piece": group.column("piece"),
                "bin_id": pa.array([f"{key[0].as_py()}-{b}" for b in bins], pa.string()),
                "bin_offset": pa.array(offsets, pa.int64()),
                "unit_begin": group.column("unit_begin"),
                "unit_end": pc.add(group.column("unit_begin"), group.column("units")),
                "bin_units": pa.array([room[b] for b in bins], pa.int64()),
            }
        )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text, source): its bin and place.

    A document longer than ``capacity`` is cut there; whole cuts fill a bin
    each, the rest is packed like a short document. No bin holds two pieces of
    one source or one duplicate cluster (``text_cluster`` by default), and none
    exceeds the capacity. Short rows without texts are counted by their content
    and dealt by a hash of it, the copy's number and the piece into blocks of
    about ``block_pieces``, so every block mixes all sources, a task holds one
    block, and neither file layout nor partition count changes the result.
    Empty and null texts are one piece of the end token; an empty table gives an
    empty result.
    """
    text = F.col("text").cast("string")
    view = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest((byte_length(text) if length is None else length).cast("long"), F.lit(1)).alias("total"),
        F.col("source").cast("string").alias("source"),
        (text_cluster(text) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    # Repeated rows are folded before they move and unfolded with a number each, so that they spread over the blocks.
    short = durable(view.groupBy("doc_id", "total", "source", "cluster").agg(F.count("*").alias("copies")))
    pieces = F.floor((F.col("total") + F.lit(capacity - 1)) / F.lit(capacity)).cast("long")
    count = short.agg(F.sum(F.col("copies") * pieces)).first()[0] or 0
    blocks = max(1, -(-count // block_pieces))
    each = short.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    begin = F.col("piece") * capacity
    dealt = each.select(
        F.pmod(F.xxhash64("doc_id", "total", "source", "cluster", "copy", "piece"), F.lit(blocks)).alias("block"),
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        begin.alias("unit_begin"),
        F.least(F.col("total") - begin, F.lit(capacity)).cast("long").alias("units"),
        "source",
        "cluster",
        "copy",
    )
    return dealt.groupBy("block").applyInArrow(_pack_block(capacity), PACKED)
