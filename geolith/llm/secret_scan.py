"""Secret scans with structural confirmation.

Pattern kinds (assign, access, hex) are reported as they match. Base64 and hex
candidates, armoured blocks and dotted tokens are reported only after decoding:
``key`` for private keys whose nested lengths fit (PKCS#1, PKCS#8, SEC1, OpenSSH)
and ``token`` for signed tokens whose header and claims decode.

Defined cases: null text is empty and yields no spans; repeated rows are kept;
extra columns are dropped; an empty table gives an empty table. Offsets are code
points, ends exclusive. Every pattern looks at a character a bounded number of
times, so runs of any length take time in proportion.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from geolith.llm.batches import small_batches, strings, text_of

#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "key", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
#: A run that may hold dotted tokens; each of its characters is looked at once.
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Least lengths of a token's header and claims.
_HEADER_MIN, _CLAIMS_MIN = 8, 4
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_ONLY = re.compile(r"(?:[0-9a-f]{2}){20,}|(?:[0-9A-F]{2}){20,}")
#: Shortest value of a pattern kind.
_ASSIGN_MIN, _ACCESS_MIN = 6, 20
#: Shortest dotted token; wrapped lines and candidates are longer.
_TOKEN_MIN = _HEADER_MIN + _CLAIMS_MIN + 2
#: Lines of one width, and a shorter or equal last one.
_LINE = re.compile(r"^[\x20\t]*([A-Za-z0-9+/_-]+={0,2})[\x20\t\r]*$", re.M)
_LINE_MIN = 40

Span = tuple[str, int, int]


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, content start and end of the DER element at a place, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 128:
            return None
    return (tag, start, start + n) if start + n <= len(data) else None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill a range exactly."""
    found = []
    while start < end:
        e = _element(data[:end], start)
        if e is None:
            return None
        found.append(e)
        start = e[2]
    return found


def _der_key(data: bytes) -> bool:
    """A private key in DER whose nested lengths all fit."""
    top = _element(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _elements(data, top[1], top[2])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags, version = [e[0] for e in inner], data[inner[0][1]]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm starts with an object identifier
        algorithm = _elements(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and inner[1][2] - inner[1][1] >= 16  # SEC1


def _openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, then length-prefixed strings that fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def _unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def confirmed_key(text: str) -> bool:
    """Whether base64 or hex text decodes to a private key."""
    decoded = [_unbase64(text)]
    if _HEX_ONLY.fullmatch(text):
        decoded.append(bytes.fromhex(text))
    return any(d is not None and (_der_key(d) or _openssh_key(d)) for d in decoded)


def confirmed_token(text: str) -> bool:
    """Whether a dotted token has a JSON header that names an algorithm, JSON claims and a signature."""
    parts = text.split(".")
    if len(parts) != 3:
        return False
    decoded = [_unbase64(p) for p in parts]
    if any(d is None for d in decoded):
        return False
    try:
        header, claims = (json.loads(d) for d in decoded[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (header["alg"].lower() == "none" or len(decoded[2]) >= 16)


def base_spans(text: str, long_words: bool) -> list[Span]:
    """Pattern spans. long_words: the text has a word of _ACCESS_MIN characters or more."""
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_MIN]
    if long_words:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_MIN]
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return spans


def wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive base64 lines: of one width of at least _LINE_MIN, then at most one shorter line, and the same without it."""
    start = end = width = lines = 0
    for m in _LINE.finditer(text):
        size = m.end(1) - m.start(1)
        if lines and width and text.count("\n", end, m.start(1)) == 1 and size <= width:
            full, end, lines = end, m.end(1), lines + 1
            if size == width and not m[1].endswith("="):
                continue
            if lines > 2:  # the short line may be a word of its own
                yield start, full
            yield start, end
            lines = 0
            continue
        if lines > 1:
            yield start, end
        start, end, width = m.start(1), m.end(1), size
        lines = 1 if size >= _LINE_MIN and not m[1].endswith("=") else 0
    if lines > 1:
        yield start, end


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of signed tokens: three parts between dots that decode; parts of a token begin no other."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < _TOKEN_MIN or "." not in run[0]:
            continue
        parts, at = run[0].split("."), run.start()
        starts = [at]
        for p in parts[:-1]:
            starts.append(starts[-1] + len(p) + 1)
        k = 0
        while k + 2 < len(parts):
            end = starts[k + 2] + len(parts[k + 2])
            if len(parts[k]) >= _HEADER_MIN and len(parts[k + 1]) >= _CLAIMS_MIN and confirmed_token(text[starts[k] : end]):
                yield starts[k], end
                k += 3
            else:
                k += 1


class _Taken:
    """Ranges that don't overlap, for tests of overlap."""

    def __init__(self, spans: list[Span]):
        self.ranges = sorted((s, e) for _, s, e in spans)

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.ranges, (end, -1))
        return k == 0 or self.ranges[k - 1][1] <= start


def confirmed_spans(text: str) -> list[Span]:
    """Keys and signed tokens that decode."""
    spans = [("key", *m.span()) for m in _ARMOUR.finditer(text) if confirmed_key(m[2])]
    taken = _Taken(spans)
    spans += [("token", a, b) for a, b in tokens(text) if taken.free(a, b)]
    if "\n" in text:
        taken = _Taken(spans)
        for a, b in wrapped(text):
            if taken.free(a, b) and confirmed_key(text[a:b]):
                spans.append(("key", a, b))
                taken = _Taken(spans)
    taken = _Taken(spans)
    spans += [("key", *m.span()) for m in _CANDIDATE.finditer(text) if taken.free(*m.span()) and confirmed_key(m[0])]
    return spans


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and all spans, each by start and then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    longest = max(map(len, text.split()), default=0)
    base = base_spans(text, longest >= _ACCESS_MIN)
    more = confirmed_spans(text) if longest >= _TOKEN_MIN or "-----BEGIN" in text else []
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (joined) and found (structs with kind, start and end)."""
    small_batches(df.sparkSession)
    rows = text_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(t) for t in strings(b.column(1))]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS[:3]]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            spans = pa.array([joined(s) for _, s in both], pa.string())
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in all_] for _, all_ in both], _SPAN)
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, found], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind string, start bigint, end bigint>>")
