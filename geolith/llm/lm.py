"""Language-model scores: prediction by partial matching over bytes, and a word baseline.

A trie of byte contexts, DEPTH bytes deep, counts the byte that follows; every
context byte is whole and nothing that was counted is dropped, so the trie grows
with the input. A byte's probability comes from the deepest context that has
seen it; each shallower context is reached by an escape (method C) and excludes
the bytes already seen above it; at the root's escape all bytes left are equal.
Byte 255, which UTF-8 never has, stands before a text and ends it.

The trie is no task's table. Rows are dealt to chunks of about CHUNK_BYTES; the
distinct contexts and bytes of each chunk are counted, summed by a shuffle, and
given their code lengths level by level, from the root down, by joins on the
shorter context. A context has at most 256 followers and as many contexts that
are one byte longer, so no key of these joins and windows is large. Each chunk
then gets the code lengths of its own contexts by a join on the key.

The baseline counts words over the whole training part. Words of at least one
part in FREQUENT_PARTS of all tokens number at most FREQUENT_PARTS, so these are
sent to every task; the rest are counted and joined by shuffles.

Defined cases: null text is empty (its end alone is scored); a null id is in the
training part; repeated rows are kept and counted as often as they stand; extra
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from geolith.llm.batches import small_batches, text_buffer
from geolith.llm.words import words
from geolith.tables import dropped, materialised, release

END = 255
#: Context bytes; with the byte that follows they fit a key of 64 bits.
DEPTH = 4
CHUNK_BYTES = 8 << 20
FREQUENT_PARTS = 1 << 20
#: Hash that stands for the end of a text among words.
_END_WORD = 0


#: How a byte stands in a context: whole.
CONTEXT = np.arange(256, dtype=np.uint64)
#: What stands before a text's first byte.
_START = np.uint64(END)


def context_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, and the end, of each text: context * 256 + byte; and the place where each text begins."""
    n = len(starts)
    at = starts + np.arange(n)
    data = np.empty(len(raw) + n, np.uint8)
    keep = np.ones(len(data), bool)
    keep[ends + np.arange(n)] = False
    data[keep], data[~keep] = raw, END
    cls = CONTEXT[data]
    key = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(at, ends - starts + 1)
    for back in range(1, DEPTH + 1):
        before = np.full(len(data), _START)
        before[back:] = cls[:-back]
        before[place < back] = _START
        key |= before << np.uint64(8 * back)
    return key, at


def _groups(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, side="right")))
        yield a, b
        a = b


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk: consecutive rows of a partition, about CHUNK_BYTES of text."""
    held = 0
    for b in batches:
        _, starts, ends = text_buffer(b.column(3))
        upto = held + np.cumsum(ends - starts + 1)
        held = int(upto[-1]) if len(upto) else held
        partition = b.column(0).to_numpy() >> 33 << 33
        yield pa.RecordBatch.from_arrays([pa.array(partition + (upto - 1) // CHUNK_BYTES), *b.columns], names=["chunk", *b.schema.names])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, held for a task and sent on when large."""
    held, tables = 0, []

    def sent(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 17)].view(np.int64)), pa.array(counts[a : a + (1 << 17)])], names=["key", "n"])

    for b in batches:
        raw, starts, ends = text_buffer(b.column(0))
        for i, j in _groups(raw, starts, ends):
            base = starts[i]
            keys, counts = np.unique(words(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base).hashes, return_counts=True)
            tables.append((np.r_[keys, np.uint64(_END_WORD)], np.r_[counts, j - i]))
            held += len(keys)
            if held > 1 << 20:
                tables = [_merged(tables)]
                held = len(tables[0][0])
                if held > 1 << 19:
                    yield from sent(*tables[0])
                    tables, held = [], 0
    if tables:
        yield from sent(*_merged(tables))


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts and bytes of each chunk, with their counts in its rows of training (0 where only other rows have them)."""
    chunk, tables = None, []

    def sent() -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(tables)
        for a in range(0, len(keys), 1 << 17):
            k = keys[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int64)), pa.array(k.view(np.int64)), pa.array(counts[a : a + (1 << 17)])], names=["chunk", "key", "n"])

    for b in batches:
        chunks, held_out = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True]) if len(chunks) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if chunks[x] != chunk:
                if tables:
                    yield from sent()
                chunk, tables = int(chunks[x]), []
            raw, starts, ends = text_buffer(b.column(2).slice(x, y - x))
            for i, j in _groups(raw, starts, ends):
                base = starts[i]
                key, at = context_keys(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
                trained = np.repeat(~held_out[x + i : x + j], np.diff(np.r_[at, len(key)]))
                for k, one in ((key[trained], 1), (key[~trained], 0)):
                    if len(k):
                        keys, counts = np.unique(k, return_counts=True)
                        tables.append((keys, counts * one))
            if len(tables) > 64:
                tables = [_merged(tables)]
    if tables:
        yield from sent()


def _at_depth(depth: int) -> Column:
    """A key without the context bytes beyond a depth."""
    return F.col("key").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1))


def resolved(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """key and p, the log10 probability of its byte in its context; and the written tables that it reads. counts: key and n, the times it was counted, 0 for keys that are only asked for."""
    levels = [counts]
    for depth in range(DEPTH - 1, -1, -1):
        levels.append(materialised(levels[-1].groupBy(_at_depth(depth).alias("key")).agg(F.sum("n").alias("n"))))
    seen = (F.col("n") > 0).cast("long")
    out = None
    for depth, level in enumerate(reversed(levels)):
        context = W.partitionBy(F.shiftright("key", 8))
        total = [F.sum("n").over(context).alias("total"), F.sum(seen).over(context).alias("kinds")]
        if out is None:  # beyond the root, the bytes left are equal
            out = level.select("key", "n", *total).withColumn("beyond", -F.log10(F.greatest(256 - F.col("kinds"), F.lit(1)).cast("double")))
        else:  # beyond a context: the next shorter one, without the bytes that this one has seen
            up = out.select(F.col("key").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"), F.col("beyond").alias("up_beyond"))
            level = level.join(up, _at_depth(depth - 1) == F.col("up")).select("*", *total, F.sum(seen * F.col("up_n")).over(context).alias("excluded"))
            left, kinds = F.col("up_total") - F.col("excluded"), F.when(F.col("up_kinds") == 256, 0).otherwise(F.col("up_kinds") - F.col("kinds"))
            beyond = F.when(left == 0, F.col("up_beyond")).when(F.col("up_n") > 0, F.log10(F.col("up_n") / (left + kinds))).otherwise(F.log10(kinds / (left + kinds)) + F.col("up_beyond"))
            out = level.select("key", "n", "total", "kinds", beyond.alias("beyond"))
    escapes = F.when(F.col("kinds") == 256, 0).otherwise(F.col("kinds"))  # no byte is left to escape to
    size = F.col("total") + escapes
    return out.select("key", F.when(F.col("n") > 0, F.log10(F.col("n") / size)).when(F.col("total") == 0, F.col("beyond")).otherwise(F.log10(escapes / size) + F.col("beyond")).cast("float").alias("p")), levels


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """The same rule on a dense table: log10 probability of each byte in each deepest context. counts: contexts x 256, contexts of symbols of five bits, the nearest in the lowest."""
    depths = (len(counts).bit_length() - 1) // 5
    out = np.empty(counts.shape, np.float32)
    levels = [counts]
    for depth in range(depths - 1, -1, -1):
        levels.append(counts.reshape(-1, 32**depth, 256).sum(axis=0))
    for a in range(0, len(counts), 2048):
        rows = np.arange(a, min(a + 2048, len(counts)))
        p = np.zeros((len(rows), 256))
        open_ = np.ones((len(rows), 256), bool)
        mass = np.ones(len(rows))
        for level in levels:
            c = np.where(open_, level[rows % len(level)], 0).astype(float)
            n, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
            kinds = np.where(kinds == open_.sum(axis=1), 0, kinds)  # no byte is left to escape to
            p += mass[:, None] * c / np.maximum(n + kinds, 1)[:, None]
            mass = np.where(n > 0, mass * kinds / np.maximum(n + kinds, 1), mass)
            open_ &= c == 0
        p += open_ * (mass / np.maximum(open_.sum(axis=1), 1))[:, None]
        out[rows] = np.log10(p)
    return out


class Model:
    """Frequent words and totals, which go to every task. Its size has the bounds above."""

    def __init__(self, frequent: np.ndarray, frequent_counts: np.ndarray, tokens: int, distinct: int):
        self.frequent, self.tokens, self.distinct = frequent, tokens, distinct
        self.gain = np.log10(frequent_counts + 0.5) - math.log10(0.5)
        self.unseen = math.log10(0.5) - math.log10(tokens + 0.5 * (distinct + 1))


def training(id_col: str, held_out: int = 1) -> Column:
    """Whether a row is held out of training."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == held_out, F.lit(False))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; the model is learned from the rows not held out."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), training(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = materialised(rows.mapInArrow(_chunked, f"chunk bigint, row bigint, id {kind}, held_out boolean, text string"))

    word = materialised(rows.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    tokens, distinct = (int(x or 0) for x in word.agg(F.sum("n"), F.count("n")).first())
    least = max(1, -(-tokens // FREQUENT_PARTS))
    frequent = word.where(F.col("n") >= least).select("key", "n").toArrow()  # at most FREQUENT_PARTS rows
    keys = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast(Model(keys[order], frequent["n"].to_numpy()[order], tokens, distinct))

    chunks = materialised(rows.select("chunk", "held_out", "text").mapInArrow(_count_contexts, "chunk bigint, key bigint, n bigint"))
    lengths, levels = resolved(materialised(chunks.groupBy("key").agg(F.sum("n").alias("n"))))
    asked = chunks.select("chunk", "key").join(lengths, "key").select("chunk", "key", "p")

    release(spark)

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        m, out = model.value, []
        keys = asked["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, p = keys[order], asked["p"].to_numpy()[order]
        for b in texts.drop_columns(["chunk"]).combine_chunks().to_batches():
            raw, starts, ends = text_buffer(b.column(3))
            for i, j in _groups(raw, starts, ends):
                base = starts[i]
                part, s, e = raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base
                key, at = context_keys(part, s, e)
                points = np.add.reduceat(p[np.searchsorted(keys, key)].astype(np.float64), at)
                w = words(part, s, e)
                hashes, owner = np.r_[w.hashes, np.full(j - i, _END_WORD, np.uint64)], np.r_[w.document, np.arange(j - i)]
                place = np.minimum(np.searchsorted(m.frequent, hashes), max(0, len(m.frequent) - 1))
                known = m.frequent[place] == hashes if len(m.frequent) else np.zeros(len(hashes), bool)
                size = np.bincount(owner, minlength=j - i)
                gain = np.bincount(owner[known], m.gain[place[known]], minlength=j - i)
                rare, mine = hashes[~known], owner[~known]
                order = np.argsort(mine, kind="stable")
                offsets = np.r_[0, np.cumsum(np.bincount(mine, minlength=j - i))]
                out.append(pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:3]), pa.array(size.astype(np.int64)), pa.array(np.bincount(owner[known], minlength=j - i).astype(np.int64)), pa.array(size * m.unseen + gain), pa.array(points), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rare[order].view(np.int64)))],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                ))
        return pa.Table.from_batches(out)

    scored = materialised(rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>"))
    dropped(rows, chunks, *levels)
    release(spark)
    few = word.where(F.col("n") < least).select("key", (F.log10(F.col("n") + 0.5) - math.log10(0.5)).alias("gain"))
    more = scored.select("row", F.explode("rare").alias("key")).join(few, "key").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum("gain").alias("gain"))
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )
