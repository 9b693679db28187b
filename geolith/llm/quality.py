"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_WORDS words; every passage is
described by counts over its bytes and words, and encoded. Gated attention,
learned from document labels alone, weighs the passages, and the weighted
representation is scored.

The classifier is fitted on at most SAMPLE labelled documents, those of the
smallest hash of id and label, so the sample is the same in every run. Scores
depend on the text alone.

Defined cases: null or empty text is one passage without words; rows with a null
id are scored and not learned from; labels that are null or have no document
are left out; repeated rows are kept; without any label all scores are 0.5;
extra columns are dropped (``kept`` keeps them); an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geolith.llm.batches import small_batches, text_buffer
from geolith.llm.words import words

PASSAGE_WORDS = 64
#: Labelled documents that the fit sees, at most.
SAMPLE = 6000
#: Score from which a document is predicted to be of quality.
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8

_KINDS = 9


def _kinds() -> np.ndarray:
    k = np.full(256, 6, np.uint8)  # other ASCII
    k[97:123], k[65:91], k[48:58] = 0, 1, 2
    k[[32, *range(9, 14)]] = 3
    k[[ord(c) for c in ".,;:'\"-()?"]] = 4
    k[[ord(c) for c in "*#$%&@^~=_+<>{}[]\\/"]] = 5
    k[ord("!")], k[ord("|")] = 7, 7
    k[128:] = 8
    return k


_KIND = _kinds()
#: Shares of byte kinds; then mean and spread of word lengths, distinct words, words without letters, long words, line ends, size, distinct words of the document, and one.
N_FEATURES = _KINDS + 9


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes (44 bits of them) in each of n < 2 ** 20 groups."""
    key = np.sort(group.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    return np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(44)).astype(np.int64), minlength=n)


def passages(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the document each belongs to; documents are taken about a MB at a time."""
    parts, owners, a = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), side="right")))
        x, owner = _passages(raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
        parts.append(x)
        owners.append(owner + a)
        a = b
    return np.concatenate(parts), np.concatenate(owners)


def _passages(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(raw, starts, ends)
    n_docs, n_words = len(starts), len(w.hashes)
    count = np.bincount(w.document, minlength=n_docs)
    pieces = np.maximum(1, -(-count // PASSAGE_WORDS))
    owner = np.repeat(np.arange(n_docs), pieces)
    out = np.zeros((len(owner), N_FEATURES), np.float32)
    if not n_words:
        return out, owner
    first_word, first_piece = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(pieces)]
    piece = first_piece[w.document] + (np.arange(n_words) - first_word[w.document]) // PASSAGE_WORDS
    heads = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    full, size = piece[heads], np.diff(np.r_[heads, n_words]).astype(np.float32)
    begin, end = w.starts[heads], w.ends[np.r_[heads[1:], n_words] - 1]
    kind = _KIND[raw]
    within = np.repeat(np.arange(len(heads)), end - begin)
    taken = within * _KINDS + kind[np.arange(len(within)) + np.repeat(begin - np.r_[0, np.cumsum(end - begin)[:-1]], end - begin)]
    out[full, :_KINDS] = np.bincount(taken, minlength=len(heads) * _KINDS).reshape(-1, _KINDS) / (end - begin)[:, None]
    lines = np.flatnonzero(raw == 10)
    letters = np.r_[0, np.cumsum((kind <= 1) | (kind == 8), dtype=np.int32)]
    wl = (w.ends - w.starts).astype(np.float32)
    mean = np.add.reduceat(wl, heads) / size
    extra = np.zeros((len(heads), 9), np.float32)
    extra[:, 0] = mean / 10
    extra[:, 1] = np.sqrt(np.maximum(0, np.add.reduceat(wl**2, heads) / size - mean**2)) / 10
    extra[:, 2] = _distinct(piece, w.hashes, len(owner))[full] / size
    extra[:, 3] = np.add.reduceat((letters[w.ends] == letters[w.starts]).astype(np.float32), heads) / size
    extra[:, 4] = np.add.reduceat((wl > 15).astype(np.float32), heads) / size
    extra[:, 5] = (np.searchsorted(lines, end) - np.searchsorted(lines, begin)) / size
    extra[:, 6] = size / PASSAGE_WORDS
    extra[:, 7] = (_distinct(w.document, w.hashes, n_docs) / np.maximum(count, 1))[w.document[heads]]
    extra[:, 8] = 1
    out[full, _KINDS:] = extra
    return out, owner


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features + 1 x HIDDEN
    attend: np.ndarray  # HIDDEN x GATE
    gate: np.ndarray  # HIDDEN x GATE
    focus: np.ndarray  # GATE
    decide: np.ndarray  # HIDDEN + 1


def _forward(m: Model, x: np.ndarray, owner: np.ndarray, n: int) -> tuple:
    z = (x - m.mean) / m.scale
    h = np.tanh(z @ m.encode[:-1] + m.encode[-1])
    t, s = np.tanh(h @ m.attend), 1 / (1 + np.exp(-(h @ m.gate)))
    e = (t * s) @ m.focus
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, e)
    a = np.exp(e - top[owner])
    a /= np.bincount(owner, a, minlength=n)[owner]
    bag = np.zeros((n, h.shape[1]))
    np.add.at(bag, owner, a[:, None] * h)
    p = 1 / (1 + np.exp(-(bag @ m.decide[:-1] + m.decide[-1])))
    return z, h, t, s, a, bag, p


def scores(m: Model, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of each of n bags, and each passage's attention weight."""
    *_, a, _, p = _forward(m, x.astype(np.float64), owner, n)
    return p, a


def fit(x: np.ndarray, owner: np.ndarray, labels: np.ndarray, epochs: int = 40, seed: int = 5) -> Model:
    """Adam over small groups of bags; gradients of encoder, attention and scorer by hand."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w = [rng.normal(0, 0.2, (N_FEATURES + 1, HIDDEN)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, GATE), np.zeros(HIDDEN + 1)]
    if not len(labels):
        return Model(mean, scale, *w)
    v1, v2, step = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w], 0
    cut = np.searchsorted(owner, np.arange(len(labels) + 1))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 128):
            bags = order[at : at + 128]
            rows = np.concatenate([np.arange(cut[b], cut[b + 1]) for b in bags])
            mine = np.repeat(np.arange(len(bags)), cut[bags + 1] - cut[bags])
            m = Model(mean, scale, *w)
            z, h, t, s, a, bag, p = _forward(m, x[rows], mine, len(bags))
            d = (p - labels[bags]) / len(bags)
            d_bag = d[:, None] * m.decide[:-1]
            d_a = (d_bag[mine] * h).sum(axis=1)
            d_e = a * (d_a - np.bincount(mine, a * d_a, minlength=len(bags))[mine])
            d_t, d_s = d_e[:, None] * m.focus * s * (1 - t**2), d_e[:, None] * m.focus * t * s * (1 - s)
            d_h = (a[:, None] * d_bag[mine] + d_t @ m.attend.T + d_s @ m.gate.T) * (1 - h**2)
            grads = [np.vstack([z.T @ d_h, d_h.sum(axis=0)]), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, np.r_[bag.T @ d, d.sum()]]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 5e-4
            for i, g in enumerate(grads):
                g = g + 1e-4 * w[i]
                v1[i], v2[i] = 0.9 * v1[i] + 0.1 * g, 0.999 * v2[i] + 0.001 * g * g
                w[i] = w[i] - rate * (v1[i] / (1 - 0.9**step)) / (np.sqrt(v2[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *w)


def held_out(id_col: str) -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The classifier fitted on a bounded sample of the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    known = known.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).orderBy(F.xxhash64("id", "y"), "id", "y").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner = passages(*text_buffer(b.column(2)))
            cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, x binary").toArrow()
    found = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["x"].to_pylist(), strict=True))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in found]
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *bags])
    return fit(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]).astype(np.int64), np.array([r[1] for r in found], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted, and n_passages with the largest attention weight of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner = passages(*text_buffer(b.column(2)))
            p, a = scores(model, x, owner, b.num_rows)
            most = np.zeros(b.num_rows)
            np.maximum.at(most, owner, a)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.bincount(owner, minlength=b.num_rows).astype(np.int64)), pa.array(most)], names=[id_col, "held_out", "score", "predicted", "n_passages", "top_attention"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int, n_passages bigint, top_attention double")


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows predicted to lack quality; all columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner = passages(*text_buffer(b.column(at)))
            yield b.filter(pa.array(scores(model, x, owner, b.num_rows)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)
