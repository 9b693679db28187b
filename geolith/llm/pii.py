"""Personal data: base patterns and a skip-chain conditional random field.

Tokens that hold a digit or an at sign are nodes; all other tokens are fixed as
ordinary text. Neighbouring nodes share transition potentials, and tokens whose
normalised forms are equal or differ by one digit share skip potentials, so a
number seen as a card in one place is a card wherever it returns. Equal forms are
linked as a balanced tree, so evidence is never more than a few steps away. Loopy
message passing gives each node's beliefs. Runs of nodes believed to be of one
kind, and not covered by a pattern, become further spans.

The weights are learned by pseudo-likelihood from documents that a seeded
generator writes; they need no corpus and are the same in every run.

Defined cases: null text is empty and yields no spans; repeated rows are kept;
extra columns are dropped (``redact`` keeps them); an empty table gives an empty
table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolith.llm.batches import small_batches, strings, text_of

#: Order of kinds where spans start together; also the field's labels after "other".
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: A run of nodes becomes a span when each is believed this much.
BELIEF = 0.8
#: Messages have converged when none changes by more than this; loops that never settle end after so many rounds.
STILL = 1e-5
ROUNDS = 1000

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _addresses(text: str) -> list[Span]:
    """Four groups of digits between dots, leftmost first, with parts of at most 255."""
    out = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), [run.start()]
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        k = 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            if not all(four):
                k += 1 + max(i for i, p in enumerate(four) if not p)
                continue
            if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in four):
                out.append(("ip", at[k], at[k + 4] - 1))
            k += 4
    return out


def base_spans(text: str) -> list[Span]:
    """Pattern spans, by start and then kind. Every character is looked at a bounded number of times."""
    spans: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match lies within the run of its characters around an at sign
        left = at
        while left > done and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "._%+-")):
            left -= 1
        right = at + 1
        while right < len(text) and text[right].isascii() and (text[right].isalnum() or text[right] in "._%+-@"):
            right += 1
        for m in _EMAIL.finditer(text, left, right):
            spans.append(("email", *m.span()))
        done = right
        at = text.find("@", right)
    if _DIGIT.search(text):
        spans += _addresses(text)
        spans += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the field ----------------------------------------------------------------

class Graph(NamedTuple):
    spans: list[tuple[int, int]]
    features: np.ndarray  # nodes x features
    chain: np.ndarray  # pairs of neighbouring nodes
    skip: np.ndarray  # pairs of similar nodes
    covered: np.ndarray  # the pattern's label of each node, 0 if none


N_FEATURES = 26


def _features(token: str, covered: int, before: str, after: str) -> list[float]:
    n = len(_digits(token))
    bucket = 0 if n == 0 else 1 if n <= 2 else 2 if n <= 4 else 3 if n <= 9 else 4 if n <= 13 else 5 if n <= 19 else 6
    f = [0.0] * N_FEATURES
    f[0] = 1.0
    f[1 + bucket] = 1.0
    f[8 + covered] = 1.0
    f[13] = "@" in token
    f[14] = token.count(".") == 3 and n <= 12
    f[15] = token[:1] == "+"
    f[16] = "(" in token or ")" in token
    f[17] = "-" in token
    f[18] = "." in token.rstrip(".")
    f[19] = n == len(token.strip(".,;:!?|\"'"))
    f[20] = any(c.isalpha() for c in token)
    f[21] = bool(_DIGIT.search(before))
    f[22] = bool(_DIGIT.search(after))
    f[23] = 14 <= n <= 19 and luhn(_digits(token))
    f[24] = any(c in token for c in ":/$%#€")
    f[25] = before[:1] == "+"
    return f


def _keys(token: str) -> list[str]:
    """Forms under which tokens are similar: an address or its local part, or eight digits or more with at most one missing."""
    core = token.strip(".,;:!?|\"'()[]<>").lower()
    if "@" in core:
        return ["a" + core, "l" + core.split("@")[0]] if len(core) >= 5 else []
    if core.count(".") == 3 and not re.search(r"[^0-9.]", core):
        return ["i" + core]
    d = _digits(core)
    if 8 <= len(d) <= 20:
        return ["d" + d, *{"x" + d[:i] + d[i + 1 :] for i in range(len(d))}, "x" + d]
    return []


def graph(text: str, base: list[Span]) -> Graph:
    """Nodes and edges of a text. The n-th token of a form is linked to the one of half that number, so edges grow with the nodes and their tree is flat."""
    found = [m.span() for m in _NODE.finditer(text)]
    tokens = [text[s:e] for s, e in found]
    covered = np.zeros(len(found), np.int64)
    sources = list(tokens)  # what a node is compared by: its token, or the whole pattern span that begins in it
    j = 0
    for i, (s, e) in enumerate(found):
        while j < len(base) and base[j][2] <= s:
            j += 1
        if (hit := next((b for b in base[j : j + 4] if b[1] < e and s < b[2]), None)) is not None:
            covered[i] = 1 + KINDS.index(hit[0])
            sources[i] = text[hit[1] : hit[2]] if hit[1] >= s else ""
    touch = [i for i in range(len(found) - 1) if not text[found[i][1] : found[i + 1][0]].strip()]
    near = set(touch)
    rows = [_features(t, int(covered[i]), tokens[i - 1] if i - 1 in near else "", tokens[i + 1] if i in near else "") for i, t in enumerate(tokens)]
    alike: dict[str, list[int]] = {}
    skip = set()
    for i, t in enumerate(sources):
        for k in _keys(t):
            some = alike.setdefault(k, [])
            if some and some[-1] != i:
                skip.add((some[(len(some) - 1) // 2], i))
            some.append(i)
    pairs = lambda x: np.array(sorted(x), np.int64).reshape(-1, 2)
    return Graph(found, np.array(rows, float).reshape(-1, N_FEATURES), pairs((i, i + 1) for i in touch), pairs(skip), covered)


class Weights(NamedTuple):
    node: np.ndarray  # features x labels
    chain: np.ndarray  # label x next label
    skip: np.ndarray  # symmetric


def beliefs(g: Graph, w: Weights, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product over chain and skip edges, all edges at once; nodes x labels. Without rounds, until messages converge."""
    k = len(LABELS)
    unary = g.features @ w.node
    edges = np.concatenate([g.chain, g.skip])
    if not len(edges):
        out = np.exp(unary - unary.max(axis=1, keepdims=True)) if len(unary) else unary
        return out / out.sum(axis=1, keepdims=True) if len(unary) else out
    table = np.concatenate([np.broadcast_to(w.chain, (len(g.chain), k, k)), np.broadcast_to(w.skip, (len(g.skip), k, k))])
    table = np.concatenate([table, table.transpose(0, 2, 1)])  # both directions
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(source), k))
    for _ in range(rounds or ROUNDS):
        total = unary.copy()
        np.add.at(total, target, message)
        sent = (total[source] - message[back])[:, :, None] + table
        top = sent.max(axis=1)
        new = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        if rounds is None and moved < STILL:
            break
    total = unary.copy()
    np.add.at(total, target, message)
    out = np.exp(total - total.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _written(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated document and its true spans, with damaged and reformatted repeats that no pattern covers, and ordinary numbers."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    true = {
        "email": f"{rng.choice('abcdefgh')}{digits(2)}@mail{digits(1)}.example.com",
        "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": card(),
        "phone": f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
    }

    def variant(kind: str) -> str:
        value = true[kind]
        if kind == "email":
            return value.split(".example")[0]
        if kind == "card":
            i = rng.randrange(len(value))
            return value[:i] + value[i + 1 :]
        if kind == "phone":
            return rng.choice([_digits(value), value.replace("+", ""), _digits(value)[1:]])
        return value
    parts: list[tuple[str, str | None]] = []
    seen = [k for k in KINDS if rng.random() < 0.6]
    for k in seen:
        parts.append((true[k], k))
        if rng.random() < 0.5:
            parts.append((true[k], k))
        if k != "ip" and rng.random() < 0.5:
            parts.append((variant(k), k))
    for _ in range(rng.randint(2, 8)):
        parts.append((rng.choice([digits(rng.randint(1, 4)), digits(rng.randint(5, 9)), digits(rng.randint(10, 18)), f"{digits(2)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"${digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"@{rng.choice(['anna', 'team', 'x'])}{digits(1)}", f"{digits(2)}:{digits(2)}", f"abc{digits(3)}"]), None))
    rng.shuffle(parts)
    text, spans = "", []
    for value, kind in parts:
        text += " ".join(rng.choice(["the", "of", "and", "was", "in"]) for _ in range(rng.randint(1, 5))) + " "
        if kind:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + rng.choice(["", "", ",", "."]) + " "
    return text, spans


@functools.lru_cache(maxsize=1)
def trained(documents: int = 600, steps: int = 300) -> Weights:
    """Weights by pseudo-likelihood: each node's label given its neighbours' true labels."""
    rng, rows, gold, around = random.Random(7), [], [], []
    k = len(LABELS)
    for _ in range(documents):
        text, spans = _written(rng)
        g = graph(text, base_spans(text))
        y = np.array([next((1 + KINDS.index(n) for n, s, e in spans if s < b and a < e), 0) for a, b in g.spans], np.int64)
        near = np.zeros((len(y), 3, k))
        for i, j in g.chain:
            near[j, 0, y[i]] += 1
            near[i, 1, y[j]] += 1
        for i, j in g.skip:
            near[i, 2, y[j]] += 1
            near[j, 2, y[i]] += 1
        rows.append(g.features)
        gold.append(y)
        around.append(near)
    x, y, near = np.concatenate(rows), np.concatenate(gold), np.concatenate(around)
    target = np.eye(k)[y]
    weights = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        scores = x @ weights[0] + near[:, 0] @ weights[1] + near[:, 1] @ weights[1].T + near[:, 2] @ weights[2]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) / len(y)
        skip = near[:, 2].T @ d
        gradients = [x.T @ d, near[:, 0].T @ d + (near[:, 1].T @ d).T, (skip + skip.T) / 2]
        for i, grad in enumerate(gradients):
            grad = grad + 1e-4 * weights[i]
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad**2
            weights[i] -= 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Weights(*weights)


def find(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and all spans, each by start and then kind."""
    base = base_spans(text)
    g = graph(text, base)
    if not len(g.skip):  # below, a further span needs a similar token, whether or not a pattern found one
        return base, base
    b = beliefs(g, weights)
    label, sure = b.argmax(axis=1), b.max(axis=1) >= BELIEF
    linked, similar = {tuple(p) for p in g.chain.tolist()}, set(g.skip.ravel().tolist())
    more, run = [], None
    for i, (s, e) in enumerate(g.spans):
        kind = int(label[i]) if sure[i] and label[i] and not g.covered[i] else 0
        if run and kind == run[0] and (i - 1, i) in linked:
            run[2], run[3] = e, run[3] or i in similar
        else:
            if run:
                more.append(run)
            run = [kind, s, e, i in similar] if kind else None
    if run:
        more.append(run)
    extra = []
    for kind, s, e, consistent in more:
        if not consistent:  # no similar token vouches for it
            continue
        while s < e and text[s] in ".,;:!?|\"'()[]<>":
            s += 1
        while e > s and text[e - 1] in ".,;:!?|\"'()[]<>":
            e -= 1
        if s < e and not any(a < e and s < z for _, a, z in base):
            extra.append((KINDS[kind - 1], s, e))
    return base, sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced as one."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (joined) and found (structs with kind, start and end)."""
    small_batches(df.sparkSession)
    rows, weights = text_of(df, id_col, text_col), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(t, weights) for t in strings(b.column(1))]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            spans = pa.array([joined(s) for _, s in both], pa.string())
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in all_] for _, all_ in both], _SPAN)
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, found], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + "".join(f"n_{k} bigint, " for k in KINDS) + "base_sha256 string, spans string, found array<struct<kind string, start bigint, end bigint>>")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of the text replaced by its kind; all columns and rows stay, null text stays null."""
    small_batches(df.sparkSession)
    weights, at = trained(), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redacted(t, find(t, weights)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)
