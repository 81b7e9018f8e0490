"""Token ids of documents in range-coded stripes, in the order of their ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm import range_coder
from cumula.llm.byte_bpe import byte_bpe, parts
from cumula.llm.common import shared_folder, shuffle_width, texts

#: Ids from which a stripe closes behind a document, and parts a worker remembers.
STRIPE_IDS, MEMO_PARTS = range_coder.LANES * range_coder.BLOCK, 1_000_000
END_ID = 0
STRIPES = "part int, stripe int, before long, least long, doc_ids array<long>, lengths array<long>, payload binary"


class _Encoder:
    """Ids of whole texts, each distinct part encoded once while it is remembered."""

    def __init__(self, path: str):
        self.bpe, self.first, self.rest = byte_bpe(path), {}, {}

    def _known(self, memo: dict[str, bytes], wanted: list[str], lead: str) -> list[bytes]:
        missing = [p for p in dict.fromkeys(wanted) if p not in memo]
        if missing:
            if len(memo) + len(missing) > MEMO_PARTS:
                memo.clear()
                missing = list(dict.fromkeys(wanted))
            for p, ids in zip(missing, self.bpe.ids([lead + p for p in missing]), strict=True):
                memo[p] = np.array(ids, "<u2").tobytes()
        return [memo[p] for p in wanted]

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        head, *tail = parts(text)
        return np.frombuffer(b"".join(self._known(self.first, [head], "") + self._known(self.rest, tail, " ")), "<u2")


_ENCODERS: dict[str, _Encoder] = {}


def _stripes(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, _Encoder(tokenizer))
        part, stripe, before, docs, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        least = None

        def close() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            payload = range_coder.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([stripe], pa.int32()), pa.array([before], pa.int64()), pa.array([least], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "stripe", "before", "least", "doc_ids", "lengths", "payload"],
            )

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                own = np.append(encoder(t), np.uint16(END_ID))
                least = d if least is None else least
                docs.append(d)
                ids.append(own)
                held += len(own)
                if held >= STRIPE_IDS:
                    yield close()
                    stripe, before, docs, ids, held = stripe + 1, before + held, [], [], 0
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending order of doc_id.

    Rows are dealt by ranges of doc_id, so partitions follow each other in order
    (ties by text, rows without an id first). A partition writes stripes: whole
    documents of eight million ids or more, coded in blocks of 2048 to 8192 ids that
    are decoded without each other and carry checksums. Every document ends with id
    0; null and empty texts have that id alone. Ids must be below 65,536.
    """
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = view.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_stripes(tokenizer), STRIPES).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = range_coder.decode(row["payload"])
            ends = np.cumsum(row["lengths"])
            if len(ends) and ends[-1] != len(ids):
                raise ValueError("a stripe's ids and documents differ in number")
            raw, starts = ids.astype("<u4"), ends - row["lengths"]
            sums = [crc32(raw[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(stripes: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the stripes.

    start counts the ids of all documents before it. The ids of whole
    partitions are summed first: one number for each partition of the writer,
    which are as many as its setting of shuffle partitions.
    """
    spark = stripes.sparkSession
    sizes = stripes.select("part", "least", (F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).groupBy("part").agg(F.min("least").alias("least"), F.max("n").alias("n")).collect()
    sizes.sort(key=lambda r: r.part)
    ahead = np.concatenate(([0], np.cumsum([r.n for r in sizes])[:-1])).tolist() if sizes else []
    offsets = spark.createDataFrame([(r.part, int(a)) for r, a in zip(sizes, ahead, strict=True)], "part int, ahead long")
    rows = stripes.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(stripes: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document, decoded from the stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = range_coder.decode(row["payload"])
                bounds = np.concatenate(([0], np.cumsum(row["lengths"])))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return stripes.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new table in the cluster's shared folder and read the index back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path)
    return read_index(spark.read.schema(STRIPES).parquet(path))
