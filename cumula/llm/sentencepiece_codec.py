"""SentencePiece encoding that keeps the original byte span of every piece, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import texts

SPACE, MEMO_PARTS = "▁", 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """(number, wire type, value, begin, end) of every field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        begin = at
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value, begin, at


class CharacterMap:
    """Compiled normalisation rules: a double-array trie over bytes and the texts it points to."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest rule that starts at a place."""
        units, best = self.units, None
        node = self._child(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node = self._child(node, units[node])
            if leaf:
                best = units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.targets[best[0] : self.targets.index(b"\0", best[0])], best[1]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Codec:
    """A model file, opened for encoding with spans and for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = f.read()
        self.pieces: list[tuple[bytes, int]] = []
        spec, trainer, kept = b"", b"", []
        for number, _, value, begin, end in _fields(proto):
            if number == 1:
                own = {n: v for n, _, v, _, _ in _fields(value)}
                self.pieces.append((own.get(1, b""), own.get(3, NORMAL)))
            if number == 2:
                trainer = value
            if number == 3:
                spec = value
            else:
                kept.append(proto[begin:end])
        rules = {n: v for n, _, v, _, _ in _fields(spec)}
        training = {n: v for n, _, v, _, _ in _fields(trainer)}
        blob = rules.get(2, b"")
        self.map = CharacterMap(blob) if blob else None
        self.dummy, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.suffix, self.byte_fallback = bool(training.get(24, 0)), bool(training.get(35, 0))
        self.unknown_surface = training.get(44, " ⁇ ".encode())
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no rule, no prefix, no squeezing, no escaping
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + b"\x1a" + bytes([len(plain)]) + plain)
        self.end_id = self.segmenter.eos_id()
        user = sorted((p for p, kind in self.pieces if kind == USER), key=len, reverse=True)
        self.user = re.compile(b"|".join(map(re.escape, user))) if user else None
        words = [p.decode(errors="replace") for p, kind in self.pieces if kind in (NORMAL, USER, UNUSED)]
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in words)
        self.lengths = np.array([1 if kind == BYTE else len(p) for p, kind in self.pieces], np.int64)
        self.surface = [b"" if kind == CONTROL else self.unknown_surface if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE.encode(), b" ") for p, kind in self.pieces]
        self.controls = {i for i, (_, kind) in enumerate(self.pieces) if kind == CONTROL}
        self.memo: dict[str, tuple[bytes, str, bytes]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the offset of the source byte.

        Longest rules of the character map win at each place; without a rule a
        character stands for itself. All bytes that a rule yields point to
        where its source begins.
        """
        data = text.encode()
        if self.map is None and self.user is None and not self.squeeze and self.escape and not self.suffix:
            return self._plain(text, data)
        return self._ruled(data)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        if not data:
            return "", np.zeros(1, np.int64)
        width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        align = np.repeat(np.arange(len(data)), width)
        ahead = [0] * 3 if self.dummy else []
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE), np.concatenate((ahead, align, [len(data)])).astype(np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if self.user and (m := self.user.match(data, at)):
            return m[0], len(m[0])
        if self.map and (found := self.map.longest(data, at)):
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def _ruled(self, data: bytes) -> tuple[str, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def add(piece: bytes) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.squeeze:
            while at < len(data) and (p := self._prefix(data, at))[0] == b" ":
                at += p[1]
        if at == len(data):
            return "", np.array([at], np.int64)
        if self.dummy and not self.suffix:
            add(space)
        after_space = self.squeeze
        while at < len(data):
            piece, used = self._prefix(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                add(piece.replace(b" ", space))
                after_space = piece.endswith(b" ")
            at += used
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        if self.dummy and self.suffix:
            add(space)
        return out.decode(), np.array([*align, at], np.int64)

    def _learn(self, parts: set[str]) -> None:
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()
        new = [p for p in parts if p not in self.memo]
        for p, ids in zip(new, self.segmenter.encode(new, num_threads=1), strict=True):
            own = np.array(ids, np.int32)
            if self.byte_fallback:
                lengths = b""
            else:
                lengths = np.array([len(x) for x in self.segmenter.encode(p, return_type=bytes)], np.int64).tobytes()
            self.memo[p] = own.tobytes(), " ".join(map(str, ids)), lengths

    def _parts(self, text: str) -> list[str]:
        """Cut before a space mark that follows another character: no piece lies across."""
        if not self.cuttable:
            return [text] if text else []
        parts = text.split(SPACE)
        if "" in parts[1:]:
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        return ([parts[0]] if parts[0] else []) + [SPACE + p for p in parts[1:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(ids, begin, end, ids as text): begin and end are byte offsets in the UTF-8 source."""
        norm, align = self.normalise(text)
        parts = self._parts(norm)
        missing = {p for p in parts if p not in self.memo}
        if missing:
            if len(self.memo) + len(missing) > MEMO_PARTS:
                missing = set(parts)
            self._learn(missing)
        found = [self.memo[p] for p in parts]
        ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        lengths = self.lengths[ids] if self.byte_fallback else np.frombuffer(b"".join([f[2] for f in found]), np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        return ids, align[starts], align[ends], " ".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: bytes run together, wrong ones become U+FFFD, the first space mark goes."""
        surface = self.surface
        parts = [surface[i] for i in ids]
        if self.dummy or self.squeeze:
            for k, i in enumerate(ids):
                kind = self.pieces[i][1]
                if kind == CONTROL:
                    continue
                if kind != BYTE and parts[k][:1] == b" " and self.pieces[i][0].startswith(SPACE.encode()):
                    parts[k] = parts[k][1:]
                    if self.squeeze and not parts[k]:
                        continue
                break
        if not self.controls.isdisjoint(ids[:-1]):  # they part runs of bytes
            return self._decode_broken(ids, parts)
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, parts)

    def _decode_broken(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i, p in zip(ids, parts, strict=True):
            if self.pieces[i][1] == BYTE:
                run.extend(p)
            else:
                close()
                out.append(p.decode())
        close()
        return "".join(out)


_OPEN: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The model of a path, opened once in a worker."""
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, span_begin, span_end, decoded) for each row of (doc_id, text); an end id comes last.

    Spans are byte offsets in the text; the end id has the empty span behind it.
    Null and empty texts give the end id alone; every text is read to its end;
    repeated rows and rows without an id are encoded alike. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids, begins, ends, decoded = [], [], [], []
            for t in texts(b):
                own, begin, end, _ = c.encode(t)
                full, n = [*own.tolist(), c.end_id], len(t.encode())
                ids.append(full)
                begins.append([*begin.tolist(), n])
                ends.append([*end.tolist(), n])
                decoded.append(c.decode(full))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "span_begin", "span_end", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, span_begin array<long>, span_end array<long>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of the same encoding, made in the same task.

    spans_crc32 covers the begins, then the ends, as little-endian 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            counts, shas, decoded, spans = [], [], [], []
            for t in texts(b):
                ids, begin, end, written = c.encode(t)
                counts.append(len(ids) + 1)
                shas.append(hashlib.sha256((f"{written} {c.end_id}" if written else str(c.end_id)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode([*ids.tolist(), c.end_id]).encode()).hexdigest())
                n = len(t.encode())
                spans.append(zlib.crc32(np.append(end, n).astype("<i8").tobytes(), zlib.crc32(np.append(begin, n).astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded), pa.array(spans, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
