"""Benchmark decontamination: seeds that no copy can lack, then Smith-Waterman alignment.

An alignment with m matches and e changed, lost or inserted words scores 2m - e.
For an item of L words and a share s, 2m - e >= 2sL, so at most 2L(1 - s) words
are inserted or lost, at least sL item words match, and as edits part the matches
into at most e + 1 runs, at least (2s - 1)L - 1 pairs of neighbouring item words
stand side by side in the document. Where that is one pair or more, word pairs
are seeds; for shorter items, single words. Of n seeds of which q must occur, the
n - q + 1 rarest are looked up: one of them occurs in every copy. Rarity is only
the order; it is counted over the whole benchmark, however that is cut.

Documents are streamed past the seeds, a map-side join on the gram; around every
group of hits on neighbouring diagonals whose words hold enough of the item's,
document and item are aligned locally, in memory that grows with their lengths
alone. Of the best alignments that of most matches counts, then the one that ends
first, then the shortest. No document leaves its task, so passages that many
documents hold cost no shuffle.

The benchmark is a stated query set: it goes to every task in blocks of at most
BLOCK_BYTES of text, one pass over the documents for each block.

Defined cases: null text is empty and matches nothing; items without words match
nothing; an item of fewer than SHORT_WORDS words is found only in documents of at
most twice as many words, since longer ones hold such words by chance; a null
item_id is kept as null; repeated rows are reported as often as they stand; extra
columns are dropped (``decontaminated`` keeps them); empty tables give empty
tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geolith.llm.batches import small_batches, text_buffer, text_of
from geolith.llm.words import NOT_ALNUM, Words, grams, words
from geolith.tables import dropped, materialised

#: Least share of an item's best possible alignment score.
SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
#: Words of a document aligned at once.
WINDOW_WORDS = 20_000
#: Items of fewer words are evidence only where they are half of a document or more.
SHORT_WORDS = 5
#: One point of an alignment's score; below it, matches are counted.
_POINT = 1 << 32


class Alignment(NamedTuple):
    score: int
    matches: int
    doc_start: int  # words, end exclusive
    doc_end: int
    item_start: int
    item_end: int


def _row(before: np.ndarray, doc: np.ndarray, word: np.uint64, slope: np.ndarray, first: int, least: int | None) -> np.ndarray:
    """The next row of a table of alignments: first column, and no value below the least."""
    row = np.empty_like(before)
    row[0] = first
    row[1:] = np.maximum(before[:-1] + np.where(doc == word, MATCH * _POINT + 1, MISMATCH * _POINT), before[1:] + GAP * _POINT)
    if least is not None:
        np.maximum(row, least, out=row)
    return np.maximum.accumulate(row - slope) + slope


def align(item: np.ndarray, doc: np.ndarray) -> Alignment:
    """Best local alignment of two word sequences (Smith-Waterman, linear gaps), of these that of most matches, earliest end (by item, then document) and least length. Two rows are held at a time."""
    slope = np.arange(len(doc) + 1, dtype=np.int64) * GAP * _POINT
    row, best, end_i, end_j = np.zeros(len(doc) + 1, np.int64), 0, 0, 0
    for i, word in enumerate(item, 1):
        row = _row(row, doc, word, slope, 0, 0)
        if (most := int(row.max())) > best:
            best, end_i, end_j = most, i, int(row.argmax())
    if not best:
        return Alignment(0, 0, 0, 0, 0, 0)
    back = doc[max(0, end_j - 3 * end_i) : end_j][::-1]  # an alignment that scores holds no more inserted words than twice the item's
    row = slope = np.arange(len(back) + 1, dtype=np.int64) * GAP * _POINT
    for i, word in enumerate(item[:end_i][::-1], 1):
        row = _row(row, back, word, slope, i * GAP * _POINT, None)
        if row.max() == best:
            return Alignment(best // _POINT, best % _POINT, end_j - int(row.argmax()), end_j, end_i - i, end_i)
    raise AssertionError("an alignment has no start")


def least_words(length: int, score: float) -> int:
    """Words of an item that match in every alignment of the share."""
    return math.ceil(score * length - 1e-9)


def item_grams(texts: list[str | None], score: float) -> tuple[list[np.ndarray], list[tuple[int, list[int], int]]]:
    """Word hashes of each item; and the length of its seeds, all its grams of that length, and how many of them occur in every copy."""
    raw, starts, ends = text_buffer(pa.array(texts, pa.string()))
    w = words(raw, starts, ends, NOT_ALNUM)
    cuts = np.searchsorted(w.document, np.arange(len(texts) + 1))
    items = [w.hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    own = []
    for item in items:
        pairs = math.ceil((2 * score - 1) * len(item) - 1 - 1e-9)
        n, least = (2, pairs) if pairs >= 1 else (1, max(1, least_words(len(item), score)))
        one = Words(item, item.view(np.int64), item.view(np.int64), np.zeros(len(item), np.int64))
        own.append((n, grams(one, n)[0].tolist() if len(item) else [], least))
    return items, own


def _distinct(item: np.ndarray, n: int, found: list[int]) -> set[tuple[int, int]]:
    """An item's words (length 0) and grams."""
    return {(0, h) for h in item.tolist()} | {(n, h) for h in found}


class Benchmark:
    """Items as word hashes, and their seeds in sorted arrays for each gram length. counts: in how many items of the whole benchmark a gram (length, hash; length 0: a word) stands, where these items are only a block of it."""

    def __init__(self, ids: list, texts: list[str | None], score: float = SCORE, counts: dict[tuple[int, int], int] | None = None):
        self.ids, self.score = ids, score
        self.items, own = item_grams(texts, score)
        if counts is None:
            counts = Counter(g for item, (n, found, _) in zip(self.items, own, strict=True) for g in _distinct(item, n, found))
        shared = {(n, h): counts[n, h] for n, found, _ in own for h in found}
        sharing = {h: counts[0, h] for item in self.items for h in item.tolist()}
        kept: dict[int, list[tuple[int, int, int]]] = {}
        for k, (n, found, least) in enumerate(own):
            rarity = lambda q: (shared[n, found[q]], min(sharing[h] for h in self.items[k][q : q + n].tolist()), q)  # noqa: E731, B023
            for q in sorted(range(len(found)), key=rarity)[: max(1, len(found) - least + 1)]:
                kept.setdefault(n, []).append((found[q], k, q))
        self.seeds = {}
        for n, entries in kept.items():
            entries.sort()
            keys, first = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True)
            self.seeds[n] = keys, np.r_[first, len(entries)], np.array([e[1] for e in entries]), np.array([e[2] for e in entries])

    def least_words(self, length: int) -> int:
        return least_words(length, self.score)

    def hits(self, w: Words) -> dict[tuple[int, int], np.ndarray]:
        """Diagonals (document word minus item word) of seeds, ascending, by document and item."""
        found = []
        for n, (keys, first, item, place) in self.seeds.items():
            h, at = grams(w, n)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            x = np.flatnonzero(keys[k] == h)
            many = first[k[x] + 1] - first[k[x]]
            y = np.repeat(first[k[x]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            p = np.repeat(at[x], many)
            found.append(np.stack([w.document[p], item[y], p - place[y]]))
        if not found:
            return {}
        rows = np.unique(np.concatenate(found, axis=1), axis=1)
        cuts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        return {(int(part[0, 0]), int(part[1, 0])): part[2] for part in np.split(rows, cuts, axis=1) if part.size}

    def alignments(self, w: Words, cuts: np.ndarray) -> Iterator[tuple[int, int, Alignment]]:
        """Document, item and best alignment of every pair that seeds found and that can reach the score. cuts: first word of each document, and the end."""
        for (d, k), diagonals in self.hits(w).items():
            item = self.items[k]
            low, high, pad = int(cuts[d]), int(cuts[d + 1]), 1 + math.ceil(2 * (1 - self.score) * len(item))
            ranges: list[list[int]] = []
            for g in diagonals.tolist():
                a, b = max(low, g - pad), min(high, g + len(item) + pad)
                if ranges and a <= ranges[-1][1]:
                    ranges[-1][1] = max(b, ranges[-1][1])
                else:
                    ranges.append([a, b])
            best = None
            for a, b in ranges:
                for start in range(a, b, WINDOW_WORDS):
                    stop = min(b, start + WINDOW_WORDS + 2 * (len(item) + pad))
                    if np.isin(item, w.hashes[start:stop]).sum() < self.least_words(len(item)):
                        continue
                    got = align(item, w.hashes[start:stop])
                    if best is None or got.score > best.score:
                        best = got._replace(doc_start=got.doc_start + start, doc_end=got.doc_end + start)
            if best is not None:
                yield d, k, best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, score: float, block_bytes: int) -> Iterator[tuple[Benchmark, bool]]:
    """The benchmark in blocks, and whether there are several. Of several, grams are counted in shuffles over all; a block gets the counts of its own."""
    items = text_of(benchmark, item_col, text_col).toDF("item", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    found = None
    if blocks > 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words_of, own = item_grams(b.column(1).to_pylist(), score)
                rows = [(k, n, np.uint64(h).astype(np.int64)) for k, item, (length, some, _) in zip(b.column(0).to_pylist(), words_of, own, strict=True) for n, h in _distinct(item, length, some)]
                block, n, gram = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(n, pa.int32()), pa.array(gram, pa.int64())], names=["block", "n", "gram"])

        found = materialised(items.select("block", "text").mapInArrow(run, "block bigint, n int, gram bigint").groupBy("block", "n", "gram").agg(F.count(F.lit(1)).alias("items")))
        every = materialised(found.groupBy("n", "gram").agg(F.sum("items").alias("items")))
    for b in range(blocks):
        rows = sorted(items.where(F.col("block") == b).collect(), key=lambda r: (r["item"] is None, r["item"] if r["item"] is not None else 0, r["text"] or ""))
        counts = None
        if found is not None:
            mine = found.where(F.col("block") == b).select("n", "gram").join(every, ["n", "gram"]).toArrow()
            counts = dict(zip(zip(mine["n"].to_pylist(), mine["gram"].to_numpy().view(np.uint64).tolist(), strict=True), mine["items"].to_pylist(), strict=True))
        yield Benchmark([r["item"] for r in rows], [r["text"] for r in rows], score, counts), blocks > 1
    if found is not None:
        dropped(found, every)


def _found(bench: Benchmark, column: pa.Array, score: float) -> Iterator[tuple]:
    """Row, item, score, and places of every pair that reaches the score."""
    raw, starts, ends = text_buffer(column)
    w = words(raw, starts, ends, NOT_ALNUM)
    cuts = np.searchsorted(w.document, np.arange(len(starts) + 1))
    for d, k, a in bench.alignments(w, cuts):
        if len(bench.items[k]) < SHORT_WORDS and cuts[d + 1] - cuts[d] > 2 * len(bench.items[k]):
            continue
        share = a.score / (MATCH * len(bench.items[k]))
        if share >= score:
            chars = lambda x: len(raw[starts[d] : x].tobytes().decode("utf-8", "replace"))  # noqa: E731, B023
            yield d, k, share, a.matches, chars(w.starts[a.doc_start]), chars(w.ends[a.doc_end - 1]), a.item_start, a.item_end


_COLUMNS = [("score", pa.float64()), ("matches", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("item_start", pa.int64()), ("item_end", pa.int64())]


def _reporter(bench, item_type: pa.DataType, id_col: str, item_col: str, score: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_found(bench.value, b.column(1), score))
            if found:
                d, k, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([bench.value.ids[i] for i in k], item_type), *[pa.array(v, t) for v, (_, t) in zip(rest, _COLUMNS, strict=True)]], names=[id_col, item_col, *[n for n, _ in _COLUMNS]])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", score: float = SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it holds: score, matched words, start and end (code points) in the document, and words of the item."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    rows = text_of(docs, id_col, text_col)
    kinds = rows.schema[0].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, score double, matches bigint, start bigint, end bigint, item_start bigint, item_end bigint"
    out = None
    for block, several in _blocks(benchmark, item_col, item_text_col, score, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInArrow(_reporter(sent, to_arrow_type(kinds[1]), id_col, item_col, score), schema)
        if several:  # one block at a time is held by the executors
            part = materialised(part)
            sent.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", score: float = SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def cleaner(bench) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for d, *_ in _found(bench.value, b.column(at), score):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        return run

    given = docs
    for block, several in _blocks(benchmark, item_col, item_text_col, score, block_bytes):
        sent, before = docs.sparkSession.sparkContext.broadcast(block), docs
        docs = docs.mapInArrow(cleaner(sent), docs.schema)
        if several:
            docs = materialised(docs)
            sent.destroy()
            if before is not given:
                dropped(before)
    return docs
