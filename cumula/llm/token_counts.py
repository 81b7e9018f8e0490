"""Token counts by pre-token: each distinct pre-token is encoded once, frequencies do the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.byte_bpe import byte_bpe, parts
from cumula.llm.common import texts

#: Documents and frequencies of a block, pre-tokens a worker remembers, and the bits of a frequency.
BLOCK_DOCS, BLOCK_ENTRIES, MEMO, FREQ_BITS = 1 << 14, 3_000_000, 500_000, 17
#: Blocks whose sums a task holds, and the bits of an input partition's number that one group of blocks leaves out.
HELD_BLOCKS, GROUP_BITS = 256, 8
MOST = (1 << FREQ_BITS) - 1


class _Vocabulary:
    """Parts seen by a worker as numbers of pre-tokens."""

    def __init__(self, path: str):
        self.bpe, self.known, self.words = byte_bpe(path), {}, []
        self.first: dict[str, tuple[int, ...]] = {}
        self.rest: dict[str, tuple[int, ...]] = {}

    def look(self, memo: dict, part: str, text: str) -> tuple[int, ...]:
        out = []
        for p in self.bpe.pretokens(text):
            k = self.known.get(p)
            if k is None:
                k = self.known[p] = len(self.words)
                self.words.append(p)
            out.append(k)
        memo[part] = found = tuple(out)
        return found


_VOCABULARIES: dict[str, _Vocabulary] = {}


def _vocabulary(path: str) -> _Vocabulary:
    """The worker's vocabulary, begun anew where it has grown too large."""
    v = _VOCABULARIES.get(path)
    if v is None or len(v.words) > MEMO:
        v = _VOCABULARIES[path] = _Vocabulary(path)
    return v


def _blocks(path: str):
    """Frequencies of documents as rows (key, pretoken, block, entries) and one header row for each block.

    Numbers travel as packed bytes: a list column costs the Arrow writer a pass
    over its batch for every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, v = TaskContext.get().partitionId() << 32, _vocabulary(path)
        ids, sizes, words, freqs, docs, held = [], [], [], [], [], 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                own, freq = [], []
                if t:
                    head, *tail = parts(t)
                    if head:
                        own += v.first.get(head) or v.look(v.first, head, head)
                        freq += [1] * len(own)
                    rest = v.rest
                    for p, f in Counter(tail).items():
                        found = rest.get(p) or v.look(rest, p, " " + p)
                        own += found
                        freq += [f] if len(found) == 1 else [f] * len(found)
                docs.append(np.full(len(own), len(ids), np.int64))
                words.append(np.array(own, np.int64))
                freqs.append(np.array(freq, np.int64))
                ids.append(d)
                sizes.append(len(t.encode()))
                held += len(own)
                if len(ids) == BLOCK_DOCS or held >= BLOCK_ENTRIES:
                    yield from _rows(block, v, ids, sizes, words, docs, freqs)
                    block += 1
                    ids, sizes, words, freqs, docs, held = [], [], [], [], [], 0
                    v = _vocabulary(path)
        if ids:
            yield from _rows(block, v, ids, sizes, words, docs, freqs)

    return run


def _pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as bytes."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed bytes, and how many each row has."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes() if data is not None else b""
    return np.frombuffer(values, kind), np.diff(at) // np.dtype(kind).itemsize


def _rows(block: int, v: _Vocabulary, ids: list, sizes: list, words: list, docs: list, freqs: list) -> Iterator[pa.RecordBatch]:
    names = ["key", "pretoken", "block", "entries", "ids", "sizes"]
    own = np.array([0 if d is None else d for d in ids], np.int64).tobytes()
    marked = (np.array(sizes, np.int64) << 1 | np.array([d is None for d in ids], np.int64)).tobytes()  # last bit: no id
    yield pa.RecordBatch.from_arrays([pa.array([f"\0{block}"]), pa.nulls(1, pa.string()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([own], pa.binary()), pa.array([marked], pa.binary())], names=names)
    key, freq = np.concatenate(words) << 14 | np.concatenate(docs), np.concatenate(freqs)
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, freq = key[order], freq[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, freq = key[at], np.add.reduceat(freq, at)
    copies = -(-freq // MOST)  # a frequency beyond its bits is written in several entries
    if (copies > 1).any():
        last = np.cumsum(copies) - 1
        key, full = np.repeat(key, copies), np.full(int(copies.sum()), MOST)
        full[last] = freq - (copies - 1) * MOST
        freq = full
    word, entry = key >> 14, ((key & (BLOCK_DOCS - 1)) << FREQ_BITS | freq).astype(np.int32)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    bounds = np.append(start, len(word))
    for k in range(0, len(start), 20_000):
        s = start[k : k + 20_000]
        own, e = pa.array([v.words[w] for w in word[s]], pa.string()), bounds[k : k + len(s) + 1]
        n = len(s)
        yield pa.RecordBatch.from_arrays([own, own, pa.array(np.full(n, block), pa.int64()), _pack(entry[e[0] : e[-1]], e - e[0]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)


def _counted(path: str):
    """Partial sums (block, docs, sums); rows come sorted, so each distinct pre-token is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sums, last = byte_bpe(path), {}, ("", 0)
        names = ["block", "docs", "sums", "ids", "sizes"]

        def flush() -> Iterator[pa.RecordBatch]:
            for block, own in sums.items():
                docs = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([docs.astype(np.int32).tobytes()], pa.binary()), pa.array([own[docs].tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=names)
            sums.clear()

        for b in batches:
            head = pa.compute.is_null(b.column("pretoken"))
            heads = b.filter(head)
            if len(heads):
                n = len(heads)
                yield pa.RecordBatch.from_arrays([heads.column("block"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), heads.column("ids"), heads.column("sizes")], names=names)
            b = b.filter(pa.compute.invert(head))
            if not len(b):
                continue
            code = b.column("pretoken").dictionary_encode()
            words = code.dictionary.to_pylist()
            known = words[0] == last[0]  # the batch goes on with the word that the last one ended with
            made = ([last[1]] if known else []) + [len(x) for x in bpe.ids(words[known:])]
            last = words[-1], made[-1]
            n = np.array(made, np.int64)[code.indices.to_numpy()]
            entry, width = _unpack(b.column("entries"), np.int32)
            entry = entry.astype(np.int64)
            weight = np.repeat(n, width) * (entry & MOST)
            blocks, which = np.unique(b.column("block").to_numpy(), return_inverse=True)
            total = np.bincount(np.repeat(which, width) * BLOCK_DOCS + (entry >> FREQ_BITS), weight, len(blocks) * BLOCK_DOCS).astype(np.int64).reshape(-1, BLOCK_DOCS)
            for k, block in enumerate(blocks.tolist()):
                if block in sums:
                    sums[block] += total[k]
                else:
                    sums[block] = total[k].copy()
            if len(sums) > HELD_BLOCKS:
                yield from flush()
        yield from flush()

    return run


def _summed(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    heads = group.filter(pa.compute.is_valid(group.column("ids"))).combine_chunks()
    ids, marked = (_unpack(heads.column(c).combine_chunks(), np.int64)[0] for c in ("ids", "sizes"))
    rest = group.filter(pa.compute.is_null(group.column("ids"))).combine_chunks()
    total = np.zeros(len(ids), np.int64)
    if len(rest):
        docs, sums = (_unpack(rest.column(c).combine_chunks(), k)[0] for c, k in (("docs", np.int32), ("sums", np.int64)))
        np.add.at(total, docs, sums)
    return pa.table({"doc_id": pa.array(ids, mask=(marked & 1).astype(bool)), "n_bytes": pa.array(marked >> 1), "n_tokens": pa.array(total)})


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text), without begin or end tokens.

    Tasks turn blocks of documents into pre-token frequencies. The rows of one
    pre-token in 256 input partitions meet after one shuffle, are multiplied by
    the token count of that pre-token, made once, and summed by document of a
    block. A frequent pre-token has one row for each block of up to 16,384
    documents, no ids are kept. Null and empty texts count 0, long texts are read to their end,
    repeated rows and rows without an id stay rows of their own; an empty table
    gives an empty result. Blocks are numbered by input partition, so ``docs``
    should be a scan or a checkpoint, which a lost task reads alike again.
    """
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = view.mapInArrow(_blocks(tokenizer), "key string, pretoken string, block long, entries binary, ids binary, sizes binary")
    # A frequent pre-token has a row in every block: so that these meet in many tasks, keys are dealt by groups of input partitions too.
    dealt = rows.repartition("key", F.shiftright("block", 32 + GROUP_BITS)).sortWithinPartitions("key").drop("key")
    partial = dealt.mapInArrow(_counted(tokenizer), "block long, docs binary, sums binary, ids binary, sizes binary")
    return partial.groupBy("block").applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
