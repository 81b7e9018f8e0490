"""Near-duplicate lines by a deletion-neighbourhood join, the earliest kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import durable, slices

#: Least characters of a line that takes part, and the segments of a line at the second level; the edit bound is one.
MIN_CHARS, SEGMENTS = 10, 16
SPACES = " \t\r\v\f"


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion or substitution at most turns a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def _bounds(c: int, parts: int) -> list[tuple[int, int]]:
    cuts = [c * j // parts for j in range(parts + 1)]
    return [(s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if s < e]


def _outside(s: str, c: int, start: int, end: int) -> int:
    """Hash of a line without the middle that begins at ``start`` and leaves c - end characters behind it."""
    return xxhash.xxh64_intdigest(f"{c} {start} {end} {s[:start]}\0{s[len(s) - (c - end) :]}".encode())


def segment_keys(s: str, parts: int) -> list[tuple[int, int, int]]:
    """(length class, segment, key): two lines within one edit share a key.

    A line of n characters is in class n, and in class n - 1 as the longer line
    of an insertion. The edit lies in one segment; all outside it is equal.
    """
    return [(c, j, _outside(s, c, a, b)) for c in (len(s), len(s) - 1) for j, (a, b) in enumerate(_bounds(c, parts))]


def variants(s: str, c: int, segment: int, parts: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(kind, position, key) of every single deletion inside a segment; kind 1 in class n, 2 in class n - 1."""
    a, b = _bounds(c, parts)[segment]
    own = c == len(s)
    return [(1 if own else 2, i, xxhash.xxh64_intdigest((s[:i] + s[i + 1 :]).encode())) for i in range(a, b if own else b + 1)]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def eligible(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    for i, raw in enumerate((text or "").split("\n")):
        s = raw.strip(SPACES)
        if len(s) >= min_chars:
            yield i, s


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, line, h, g, n, k) of every line that takes part; k: its keys in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, ths, at, hs, gs, ns, ks = [], [], [], [], [], [], []
            for d, th, t in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
                for i, s in eligible(t, min_chars):
                    both = xxhash.xxh3_128_intdigest(s.encode())
                    ids.append(d)
                    ths.append(th)
                    at.append(i)
                    hs.append(both >> 64)
                    gs.append(both & 0xFFFFFFFFFFFFFFFF)
                    ns.append(len(s))
                    ks.append([k - (1 << 64) if k >> 63 else k for _, _, k in segment_keys(s, 2)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(at, pa.int32()), _signed(hs), _signed(gs), pa.array(ns, pa.int32()), pa.array(ks, pa.list_(pa.int64()))],
                names=["doc_id", "th", "line", "h", "g", "n", "k"],
            )

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, th long, line int, h long, g long, n int, k array<long>")


def _second_level(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(r, c, j, k) for r, s in enumerate(b.column("s").to_pylist()) for c, j, k in segment_keys(s, SEGMENTS)]
            rows = pa.array([f[0] for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("h").take(rows), b.column("g").take(rows), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), _signed([f[3] for f in found])], names=["h", "g", "c", "j", "key"])

    return lines.select("h", "g", "s").mapInArrow(run, "h long, g long, c int, j int, key long")


def _third_level(lines: DataFrame) -> DataFrame:
    """Deletion variants in the segments left, and the line itself as kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for r, (s, parts) in enumerate(zip(b.column("s").to_pylist(), b.column("parts").to_pylist(), strict=True)):
                found.append((r, 0, -1, xxhash.xxh64_intdigest(s.encode())))
                found += sorted({(r, *v) for p in parts for v in variants(s, p["c"], p["j"])})
            rows = pa.array([f[0] for f in found], pa.int32())
            own = [b.column(c).take(rows) for c in ("doc_id", "th", "line", "h", "g", "n")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), _signed([f[3] for f in found])], names=["doc_id", "th", "line", "h", "g", "n", "kind", "pos", "key"])

    return lines.select("doc_id", "th", "line", "h", "g", "n", "s", "parts").mapInArrow(run, "doc_id long, th long, line int, h long, g long, n int, kind int, pos int, key long")


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [within_one(x, y) for x, y in zip(b.column("s").to_pylist(), b.column("s2").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["doc_id", "th", "line"])

    return pairs.select("doc_id", "th", "line", "s", "s2").mapInArrow(run, "doc_id long, th long, line int")


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, line) of every line that has an earlier one within the edit bound.

    ``docs`` has doc_id, text and th (a hash of the text). Earlier means a lesser
    (doc_id, th, line). The neighbourhood is emitted from coarse to fine: first
    each line without either half, then without each of 16 segments, and single
    deletions only inside segments whose rest another line shares; lines that
    are dropped on the way provably have no partner. Lines of one length that
    agree after the same deletion are all within one substitution, so the
    earliest of them stands for all; a line that equals another's variant is one
    insertion away. So nothing is paired with everything in its group.
    """
    dealt = docs.where("doc_id is not null")  # the same scan and shuffle as that of the final join
    lines = _lines(docs, min_chars)
    rank = F.struct("doc_id", "th", "line")
    distinct = durable(lines.groupBy("h", "g").agg(F.min(rank).alias("f"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("k").alias("k")).select("h", "g", "f.*", "copies", "n", "k"))

    copied = distinct.where("copies > 1").select("h", "g", F.struct("doc_id", "th", "line").alias("f"))
    exact = lines.select("doc_id", "th", "line", "h", "g").join(copied, ["h", "g"]).where(F.struct("doc_id", "th", "line") > F.col("f")).select("doc_id", "th", "line")

    keys = distinct.select("h", F.explode("k").alias("key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    near = distinct.join(keys.join(shared, "key", "left_semi").select("h").distinct(), "h", "left_semi")
    wanted = near.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "h", "g", "n")).alias("w"))
    # The lines are bound once and picked before the rows multiply, so a document costs its own length.
    picked = F.transform(F.array(F.split(F.coalesce("text", F.lit("")), "\n")), lambda lines: F.transform("w", lambda w: F.struct(w["line"].alias("line"), w["h"].alias("h"), w["g"].alias("g"), w["n"].alias("n"), F.btrim(F.get(lines, w["line"]), F.lit(SPACES)).alias("s"))))
    found = dealt.join(wanted.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", F.inline(F.get(picked, 0)))
    texts = durable(found.dropDuplicates(["h", "g"]))

    second = _second_level(texts)
    both = second.groupBy("key").count().where("count > 1").select("key")
    parts = second.join(both, "key", "left_semi").groupBy("h", "g").agg(F.collect_set(F.struct("c", "j")).alias("parts"))
    out = durable(_third_level(texts.join(parts, ["h", "g"])))
    who = F.struct("doc_id", "th", "line", "h", "g")
    same = out.where("kind = 1")
    least = same.groupBy("key", "n", "pos").agg(F.min(who).alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    replaced = same.join(least, ["key", "n", "pos"]).select(who.alias("x"), F.col("m").alias("y"))
    longer = out.where("kind = 2").select("key", (F.col("n") - 1).alias("n"), who.alias("x"))
    inserted = longer.join(out.where("kind = 0").select("key", "n", who.alias("y")), ["key", "n"]).select("x", "y")
    pairs = replaced.union(inserted).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    s1, s2 = texts.select("h", "g", "s"), texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("s").alias("s2"))
    read = pairs.select("x.*", F.col("y.h").alias("h2"), F.col("y.g").alias("g2")).join(s1, ["h", "g"]).join(s2, ["h2", "g2"])
    return exact.union(_verified(read)).distinct()


def _cut(docs: DataFrame, min_chars: int) -> DataFrame:
    """``row``, text (cut), n_lines, n_removed and emptied for (row, doc_id, text)."""
    view = docs.withColumn("th", F.xxhash64("text"))
    gone = removed_lines(view.select("doc_id", "text", "th"), min_chars).groupBy("doc_id", "th").agg(F.collect_list("line").alias("gone"))
    joined = view.where("doc_id is not null").join(gone.hint("merge"), ["doc_id", "th"], "left")
    lines = joined.unionByName(view.where("doc_id is null").withColumn("gone", F.lit(None).cast("array<int>"))).withColumn("all", F.split("text", "\n"))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"))
    lost = F.col("gone").isNotNull()
    cut = lines.withColumn("cut", F.when(lost, F.array_join(F.transform(left, lambda i: F.get("all", i)), "\n")).otherwise(F.col("text")))
    bare = F.btrim(F.regexp_replace("cut", "\n", " "), F.lit(SPACES)) == ""
    return cut.withColumns({"text": F.col("cut"), "n_lines": F.when(F.col("all").isNull(), 0).otherwise(F.size("all")), "n_removed": F.when(lost, F.size("gone")).otherwise(0), "emptied": lost & bare}).drop("cut", "all", "gone", "th")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, emptied) for each row of ``docs`` (doc_id, text).

    A line of ``min_chars`` characters or more, white space at its ends not
    counted, goes if an earlier line is equal or one edit away; shorter and
    blank lines stay. ``text`` has the lines left. Null texts come back null
    without lines, rows without an id unchanged; repeated rows count as one
    document and come back alike; ``emptied`` marks texts that lost their last
    line with a word. An empty table gives an empty result.
    """
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _cut(view, min_chars).select("doc_id", "text", "n_lines", "n_removed", "emptied")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with their texts cut; rows that are emptied go, n_chars follows the text."""
    view = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    changed = {"text": F.col("text")} | ({"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _cut(view, min_chars).where("not emptied").select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
