"""SentencePiece encoding with byte spans, and decoding.

Every text is normalised by longest prefixes of the model's compiled character
map; every normalised byte remembers the source byte it came from, and stretches
where no prefix can begin are copied as they are. Pieces of the normalised text
are then projected through this alignment to spans of the source's UTF-8 bytes;
pieces that don't fill the normalised text are an error. Where no piece of the
model holds a word mark after another character, words are encoded on their own
and their ids kept in a bounded table.

Defined cases: null text is empty and has no ids; repeated rows are kept; extra
columns are dropped; an empty table gives an empty table; a word of any length
is encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolith.llm.batches import small_batches, strings, text_of

MARK = "▁"
#: Words whose ids a worker keeps; the table is emptied when full.
KEPT_WORDS = 250_000
KEPT_WORD_CHARS = 64

_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """Field number, wire type, value and raw bytes of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        start = at
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value, data[start:at]


class CharsMap:
    """The compiled character map: a double-array trie over source prefixes, with their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]

    def begins(self) -> np.ndarray:
        """Which bytes begin a mapped prefix."""
        found = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            for b in range(1, 256):
                found[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at a place, and what replaces it."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """Normalised bytes with the source place of each."""

    def __init__(self, spec: bytes):
        got = {n: v for n, _, v, _ in _fields(spec)}
        self.map = CharsMap(got.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.identity = not self.map.units and not self.squeeze and self.dummy_prefix and self.escape
        self.space = MARK.encode() if self.escape else b" "
        self.stops = self.map.begins()
        self.stops[32] |= self.squeeze

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if (hit := self.map.longest(data, at)) is not None:
            return hit
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return n, data[at : at + n]

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """align[i] is the source byte at which normalised byte i begins; align[-1] the source's end."""
        raw, space, at = np.frombuffer(data, np.uint8), self.space, 0
        if self.squeeze:
            while at < len(data) and (p := self._prefix(data, at))[1] == b" ":
                at += p[0]
        if at >= len(data):
            return b"", np.array([at], np.int64)
        out, align = [space] if self.dummy_prefix else [], [np.full(len(space) if self.dummy_prefix else 0, at, np.int64)]
        after_space = self.squeeze
        for stop in [*(np.flatnonzero(self.stops[raw]).tolist() if self.stops.any() else ()), len(data)]:
            if stop < at:  # within a prefix already taken
                continue
            if stop > at:
                out.append(data[at:stop].replace(b" ", space))
                align.append(np.repeat(np.arange(at, stop), np.where(raw[at:stop] == 32, len(space), 1)))
                after_space = False
            if stop == len(data):
                break
            n, text = self._prefix(data, stop)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                out.append(text.replace(b" ", space))
                align.append(np.full(len(out[-1]), stop))
                after_space = self.squeeze and text.endswith(b" ")
            at = stop + n
        made, places, end = b"".join(out), np.concatenate(align), len(data)
        if self.squeeze:
            while made.endswith(space):
                end = int(places[len(made) - len(space)])
                made, places = made[: -len(space)], places[: -len(space)]
        return made, np.r_[places, end]


class Encoded(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """A model, its normaliser and a bounded table of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        fields = list(_fields(model))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser(next((v for n, _, v, _ in fields if n == 3), b""))
        plain = b"\x0a\x08identity\x18\0\x20\0\x28\1"
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=b"".join(raw for n, _, _, raw in fields if n != 3) + bytes([0x1A, len(plain)]) + plain)
        pieces, kinds = [], []
        for n, _, value, _ in fields:
            if n == 1:
                got = {k: v for k, _, v, _ in _fields(value)}
                pieces.append(got[1].decode())
                kinds.append(got.get(3, _NORMAL))
        if _USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), -1)
        self.byte = np.array([k == _BYTE for k in kinds])
        self.size = np.array([1 if k == _BYTE else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)], np.int64)
        normal = [p for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL]
        trainer = next((v for n, _, v, _ in fields if n == 2), b"")
        bpe = next((v for n, _, v, _ in _fields(trainer) if n == 3), 1) == 2
        self.by_word = bpe and "<0x0A>" in pieces and self.normaliser.identity and not any(MARK in p.lstrip(MARK) or " " in p or "\n" in p for p in normal)
        self.words: dict[str, tuple[str, bytes]] = {}
        self.text = [str(i) for i in range(len(pieces))]
        self.line_feed = next((i for i, p in enumerate(pieces) if p == "<0x0A>" and self.byte[i]), -1)

    def _learn(self, words: set[str]) -> dict[str, tuple[str, bytes]]:
        """Entries of words without inner line feeds: with their leading spaces, or from a line's start."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        words.discard("\n")
        listed, made = list(words), {"\n": (str(self.line_feed), array("i", [self.line_feed]).tobytes())}
        if listed:  # no piece holds a line feed, so one call encodes all words, each on a line
            ids = array("i", self.plain.encode("\n".join(listed)))
            said = ",".join([self.text[i] for i in ids]).split(f",{self.line_feed},")
            raw, ends = ids.tobytes(), np.flatnonzero(np.frombuffer(ids, np.int32) == self.line_feed).tolist()
            made |= {w: (t, raw[4 * a : 4 * e]) for w, t, a, e in zip(listed, said, [0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)}
        self.words.update((w, e) for w, e in made.items() if len(w) <= KEPT_WORD_CHARS)
        return made

    def _by_word(self, text: str) -> list[tuple[str, bytes]]:
        words: list[str] = []
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                words.append("\n")
            if "  " in line or line[-1:] == " ":
                words += re.findall(r" *[^ ]+| +", line)
            elif line:
                first, *rest = line.split(" ")
                words += [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]
        got = list(map(self.words.get, words))
        if None in got:
            made = self._learn({w for w, g in zip(words, got, strict=True) if g is None})
            got = [g or made[w] for w, g in zip(words, got, strict=True)]
        return got

    def encode_joined(self, text: str) -> tuple[Encoded, str]:
        """Ids with source byte spans, and the ids in decimal, joined by commas."""
        if not text:
            none = np.zeros(0, np.int64)
            return Encoded(np.zeros(0, np.int32), none, none), ""
        data, at = self.normaliser(text.encode())
        if self.by_word and MARK not in text:
            got = self._by_word(text)
            ids, said = np.frombuffer(b"".join([g[1] for g in got]), np.int32), ",".join([g[0] for g in got])
        else:
            ids = np.array(self.plain.encode(data.decode()), np.int32) if data else np.zeros(0, np.int32)
            said = ",".join(map(str, ids.tolist()))
        sizes = self._sizes_with_unknown(ids, data.decode()) if self.unknown in ids else self.size[ids]
        ends = np.cumsum(sizes)
        if len(data) != (ends[-1] if len(ends) else 0):
            raise ValueError("pieces do not fill the normalised text")
        return Encoded(ids, at[ends - sizes], at[ends]), said

    def _sizes_with_unknown(self, ids: np.ndarray, text: str) -> np.ndarray:
        return np.array([len(p.piece.encode()) for p in self.plain.encode(text, out_type="immutable_proto").pieces], np.int64)

    def encode(self, text: str) -> Encoded:
        return self.encode_joined(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec of a model file, which every executor must see at this path."""
    return Codec(path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, starts, ends (source bytes) and decoded text."""
    small_batches(df.sparkSession, 64)
    rows = text_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            made = [c.encode(t) for t in strings(b.column(1))]
            lists = [pa.array([e[k] for e in made], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array([c.decode(e.ids.tolist()) for e in made], pa.string())], names=[id_col, "ids", "starts", "ends", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text of lists of ids; null is empty."""
    small_batches(df.sparkSession, 64)
    rows = df.select(f"`{id_col}`", f"`{ids_col}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, decoded string")


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256: digests of what encode() returns, made where the ids are; with_ids adds the ids."""
    small_batches(df.sparkSession)
    rows = text_of(df, id_col, text_col)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def digest(c: Codec, text: str) -> tuple[int, str, str, str, np.ndarray]:
        e, said = c.encode_joined(text)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return len(e.ids), sha(said.encode()), sha(c.decode(e.ids.tolist()).encode()), sha(e.ends.astype("<i8").tobytes()), e.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            made = [digest(c, t) for t in strings(b.column(1))]
            columns = [pa.array([m[k] for m in made], pa.string() if k else pa.int64()) for k in range(4)]
            if with_ids:
                columns.append(pa.array([m[4] for m in made], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *names, *["ids"] * with_ids])

    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)
