"""N-gram Jaccard join with signature trees.

A document's set is its distinct word n-grams (hashes); documents with equal
sets form one class, so exact copies never meet as pairs. Classes link when
their sets' Jaccard similarity reaches a threshold; the operator returns the
connected components of all links, without emitting a group's pairs.

Candidates meet in two rounds:

1. Classes that share two minimum hashes meet in blocks of bounded size with
   their packed texts. A signature tree over each block holds, in every node, the
   OR of its sets' bitmaps and their size range; a dual traversal drops node
   pairs whose largest possible overlap is too small, or that are already
   connected, and verifies the rest exactly. Links leave a block as stars.
2. The prefix of a set, in any one order of all grams, shares several grams
   (shared_least) with the prefix of every set it can link with. Classes whose
   prefix shares fewer with other components can link no further and go. Of m
   shared prefix grams of which s must be common with every partner, the
   m - s + 1 rarest hold one of them; by these the classes left meet with their
   bitmaps. The same traversal, now between components only, gives candidate
   pairs, which are verified exactly.

The members of a hot gram are dealt to cells by size, so that only sizes that can
link meet, and those of the gram's largest component to cells of their own, which
don't meet each other; cells are cut into blocks that meet in pairs.

No link is lost: round 1 only saves work, round 2 covers every pair. Components
are found by star contraction in shuffles. What is sent to every task is bounded:
frequent grams with their counts (at most 1 / FREQUENT times the mean set size)
and BUCKETS flags. Joins whose sides grow with the input are sort-merge joins
whatever their size, so that a plan that fits a small input is the plan of a
large one; written tables go as soon as their last reader has run.

Defined cases: null or empty text has an empty set and links with nothing; a
text of fewer words is one gram; rows with a null id are returned with a null
component and link nothing; repeated rows are kept and are one class; extra
columns are dropped (``deduplicated`` keeps them); an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geolith.llm.batches import small_batches, text_buffer
from geolith.llm.words import Words, grams, mix, words
from geolith.operators.components import components
from geolith.tables import dropped, few, gathered, materialised, release

#: Grams in more than this share of a task's documents are counted as possibly frequent.
FREQUENT = 1e-3
FREQUENT_LEAST = 64
#: Pairs of minimum hashes by which classes meet.
ROUTES = 3
_TURNS = mix(np.arange(1, 2 * ROUTES + 1, dtype=np.uint64)) | np.uint64(1)
BLOCK = 256
PAIR_BLOCK = 256
BUCKETS = 1 << 20
LARGEST_BITMAP = 1 << 14
#: A prefix is longer by one gram for so many grams of the set.
PER_SHARED = 16
#: Bits a gram, and bits at least, of the bitmaps that travel.
SENT_BITS = 2, 1024
#: Parts over which the rows of a frequent gram are dealt.
SALTS = 256
LEAF, FAN_OUT = 16, 8

_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct grams of every document."""
    w = words(raw, starts, ends)
    cuts = np.searchsorted(w.document, np.arange(len(starts) + 1))
    h, place = grams(w, n)
    at = np.searchsorted(place, cuts)
    for d in range(len(starts)):
        count = cuts[d + 1] - cuts[d]
        if count >= n:
            yield np.unique(h[at[d] : at[d + 1]])
        elif count:
            own = w.hashes[cuts[d] : cuts[d + 1]]
            yield grams(Words(own, own, own, np.zeros(count, np.int64)), int(count))[0]
        else:
            yield np.zeros(0, np.uint64)


def _groups(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """shingles() over about a MB of text at a time."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), side="right")))
        yield from shingles(raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], n)
        a = b


def set_id(s: np.ndarray) -> int:
    """A hash of a whole set."""
    if not len(s):
        return 0
    total = mix(s ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection of two linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shared_least(n: int) -> int:
    """Grams that a set's prefix is long enough to share with every set it links with; grows with the set."""
    return 1 + n // PER_SHARED


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    same = both - len(np.union1d(a, b))
    return 100 * same >= percent * (both - same)


# -- signature trees ----------------------------------------------------------

def width_of(n: int, per_gram: int = 8, least: int = 64) -> int:
    """Bits of a set's bitmap: a power of two, so many a gram or more, within limits."""
    return min(LARGEST_BITMAP, max(least, 1 << (per_gram * n - 1).bit_length()))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(width, bool)
    flags[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Tree:
    """Levels of nodes over sets ordered by size: OR-combined bitmaps, size ranges, and the most grams that share a bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.bits = sizes[self.order], bits[self.order]
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(axis=1)
        low, high, bit, slack = self.sizes, self.sizes, self.bits, self.slack
        self.levels, step = [], LEAF
        while True:
            heads = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            bit, slack = np.bitwise_or.reduceat(bit, heads, axis=0), np.maximum.reduceat(slack, heads)
            self.levels.append((low, high, bit, slack))
            step = FAN_OUT
            if len(low) == 1:
                break


def _possible(low_a, high_a, bits_a, slack_a, low_b, high_b, bits_b, slack_b, percent: int) -> np.ndarray:
    """Which pairs of nodes (or sets) of two lists may hold a linked pair."""
    bound = np.bitwise_count(bits_a[:, None, :] & bits_b[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(slack_a[:, None], slack_b[None, :])
    need = -(-percent * (low_a[:, None] + low_b[None, :]) // (100 + percent))
    return (bound >= need) & (100 * high_a[:, None] >= percent * low_b[None, :]) & (100 * high_b[None, :] >= percent * low_a[:, None])


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: places (in the trees' input) of sets of a and of b that may link, leaf pair by leaf pair. With a is b every unordered pair comes once."""
    same = a is b
    stack = [(len(a.levels) - 1, np.arange(1), len(b.levels) - 1, np.arange(1))]
    while stack:
        la, na, lb, nb = stack.pop()
        ok = _possible(*(x[na] for x in a.levels[la]), *(x[nb] for x in b.levels[lb]), percent)
        for i, j in zip(*np.nonzero(ok), strict=True):
            p, q = int(na[i]), int(nb[j])
            if same and la == lb and p > q:
                continue
            if la == 0 and lb == 0:
                x = np.arange(p * LEAF, min((p + 1) * LEAF, len(a.sizes)))
                y = np.arange(q * LEAF, min((q + 1) * LEAF, len(b.sizes)))
                hit = _possible(a.sizes[x], a.sizes[x], a.bits[x], a.slack[x], b.sizes[y], b.sizes[y], b.bits[y], b.slack[y], percent)
                if same and p == q:
                    hit = np.triu(hit, 1)
                if hit.any():
                    u, v = np.nonzero(hit)
                    yield a.order[x[u]], b.order[y[v]]
            else:
                down = lambda t, level, k: (level, np.array([k])) if level == 0 else (level - 1, np.arange(k * FAN_OUT, min((k + 1) * FAN_OUT, len(t.levels[level - 1][0]))))
                if la == lb:
                    stack.append((*down(a, la, p), *down(b, lb, q)))
                elif la > lb:
                    stack.append((*down(a, la, p), lb, np.array([q])))
                else:
                    stack.append((la, np.array([p]), *down(b, lb, q)))


def candidates(sizes: np.ndarray, bits: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that may link. Sets of one bitmap width form a tree; sets of the next width are folded to meet it.
    side: if given, only pairs of different sides."""
    widths = np.array([len(x) for x in bits])
    sides = [np.arange(len(sizes))] if side is None else [np.flatnonzero(side == k) for k in (0, 1)]

    def tree(members: np.ndarray, width: int) -> Tree | None:
        if not len(members):
            return None
        return Tree(sizes[members], np.stack([bits[m] if len(bits[m]) == width else bits[m][:width] | bits[m][width:] for m in members]))

    for width in np.unique(widths):
        own = [s[widths[s] == width] for s in sides]
        more = [s[widths[s] == 2 * width] for s in sides]
        trees, folded = [tree(m, width) for m in own], [tree(m, width) for m in more]
        meet = [(trees[0], own[0], trees[0], own[0]), (trees[0], own[0], folded[0], more[0])] if side is None else [(trees[0], own[0], trees[1], own[1]), (trees[0], own[0], folded[1], more[1]), (folded[0], more[0], trees[1], own[1])]
        for a, ma, b, mb in meet:
            if a is not None and b is not None:
                for x, y in traverse(a, b, percent):
                    yield ma[x], mb[y]


def stars(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within a block as (least id, other id) of every connected group; pairs already connected are not verified."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    for x, y in candidates(sizes, [bitmap(s, width_of(len(s))) for s in sets], percent):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q and (ids[i] == ids[j] or linked(sets[i], sets[j], percent)):
                root[max(p, q)] = min(p, q)
    least: dict[int, int] = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, int(ids[i])), int(ids[i]))
    return [(least[find(i)], int(ids[i])) for i in range(len(ids)) if least[find(i)] != ids[i]]


# -- the join -----------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of each run of equal keys (the first columns) of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(c.to_pylist() for c in b.columns[:n_keys]), strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, k
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _describe(n: int, percent: int) -> Callable:
    """For every document its set's id, size and minimum hashes; and grams that are frequent among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "cid", "n", *(f"m{k}" for k in range(ROUTES)), "gram", "times"]
        tables, held, docs = [], 0, 0
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            sets = list(_groups(*text_buffer(b.column(1)), n))
            docs += len(sets)
            least = [[(s * t).min() for t in _TURNS] if len(s) else None for s in sets]
            mins = [[None if m is None else int(mix(mix(m[2 * k : 2 * k + 1]) + m[2 * k + 1]).view(np.int64)[0]) for m in least] for k in range(ROUTES)]
            empty = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(m, pa.int64()) for m in mins], empty, empty], names=names)
            if sets:
                g, c = np.unique(np.concatenate(sets), return_counts=True)
                tables.append((g, c))
                held += len(g)
            if held > 1 << 21:
                tables = [_frequent(tables, docs)]
                held = len(tables[0][0])
        if tables:
            g, c = _frequent(tables, docs)
            none = pa.nulls(len(g), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(g), kind), none, none, *[none] * ROUTES, pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

    return run


def _frequent(tables: list[tuple[np.ndarray, np.ndarray]], docs: int) -> tuple[np.ndarray, np.ndarray]:
    g, c = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    if len(g):
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        g, c = g[heads], np.add.reduceat(c, heads)
    keep = c >= max(8, FREQUENT * docs)
    return g[keep], c[keep]


def _among(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(often):
        return np.zeros(len(s), bool)
    return often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut only where its value changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy() for c in b.columns]
        last = np.flatnonzero(rows[0][1:] != rows[0][:-1])
        if held and rows[0][0] != held[-1][0][-1]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(last):
            cut = int(last[-1]) + 1
            yield [np.concatenate(x) for x in zip(*held, [r[:cut] for r in rows], strict=True)]
            held = [[r[cut:] for r in rows]]
        else:
            held.append(rows)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _packed(column: pa.Array) -> pa.Array:
    """Texts as bytes: the size, then the text compressed; null is empty."""
    raw, starts, ends = text_buffer(column)
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([(e - s).astype("<i8").tobytes() + codec.compress(raw[s:e].tobytes(), asbytes=True) for s, e in zip(starts, ends, strict=True)], pa.binary())


def _unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all packed texts, with the start and end of each."""
    texts = [pa.decompress(v[8:], int.from_bytes(v[:8], "little"), "zstd", asbytes=True) if len(v) > 8 else b"" for v in values]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[np.int64(0), ends[:-1]], ends


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def _only(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Rows of df that may have a wanted value: a semi join with at most BUCKETS flags, so it is always broadcast."""
    flags = wanted.select(_bucket(wanted_column).alias("bucket")).distinct()
    return df.withColumn("bucket", _bucket(column)).join(F.broadcast(flags), "bucket", "left_semi").drop("bucket")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_gram: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every row."""
    return _joined(df, id_col, text_col, words_in_gram, percent)[0]


def _joined(df: DataFrame, id_col: str, text_col: str, words_in_gram: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """join(), and the written tables that it reads."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    mins = [f"m{k}" for k in range(ROUTES)]
    described = materialised(gathered(docs.mapInArrow(_describe(words_in_gram, percent), f"id {kind}, cid bigint, n bigint, " + "".join(f"{m} bigint, " for m in mins) + "gram bigint, times bigint")))
    own = described.where("times is null")
    classes = materialised(few(own.where("n > 0 and id is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in mins])))

    total = classes.count()
    grams_seen = described.where("times is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    found = grams_seen.where(F.col("times") >= max(FREQUENT_LEAST, FREQUENT * total)).toArrow()
    values = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], found["times"].to_numpy()[order]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_id(s) for s in _groups(*text_buffer(b.column(1)), words_in_gram)], pa.int64()), _packed(b.column(1))], names=["rep", "cid", "text"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        """wanted (cid, rep, ...) with the packed text of each class's least document."""
        made = _only(docs.where("id is not null"), "id", wanted, "rep").mapInArrow(pack, f"rep {kind}, cid bigint, text binary")
        return made.join(wanted.hint("merge"), ["cid", "rep"]).dropDuplicates(["cid", "rep"]).drop("rep")

    # round 1: blocks of classes that share minimum hashes
    routes = classes.select("cid", "rep", F.explode(F.array(*[F.xxhash64(F.lit(k), m) for k, m in enumerate(mins)])).alias("route"))
    shared = materialised(few(routes.groupBy("route").agg(F.count(F.lit(1)).alias("size")).where("size > 1")))  # written, so that the join splits a hot route
    met = _only(routes, "route", shared, "route").join(shared.hint("merge"), "route")
    block = F.pmod(F.xxhash64("cid", "route"), F.ceil(F.col("size") / BLOCK))
    wanted = materialised(few(met.groupBy("cid", "rep").agg(F.collect_set(F.struct("route", block.alias("block"))).alias("meets"))))
    blocks = texts_of(wanted).select("cid", "text", F.explode("meets").alias("meet")).select("meet.route", "meet.block", "cid", "text")

    def verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2):
            if t.num_rows > 1:
                yield _pairs_out(stars(t["cid"].to_numpy(), list(_groups(*_unpacked(t["text"].to_pylist()), words_in_gram)), percent))

    links = blocks.repartition("route", "block").sortWithinPartitions("route", "block").mapInArrow(verify_blocks, "a bigint, b bigint")
    roots = components(links)
    dropped(shared, wanted)
    release(spark)

    # round 2: classes that share enough of their prefixes with other components
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value[0]
        for b in batches:
            cids, rare, hot = [], [], []
            for s in _groups(*text_buffer(b.column(1)), words_in_gram):
                cids.append(set_id(s))
                size = prefix_size(len(s), percent) + shared_least(len(s)) - 1 if len(s) else 0
                last = _among(s, often)
                rare.append(s[~last][:size].view(np.int64))
                hot.append(s[last][: size - len(rare[-1])].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, hot)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cids, pa.int64()), *lists], names=["rep", "cid", "rare", "hot"])

    def shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        for gram, cid, beside in _groups_of(batches):
            heads = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            size = np.diff(np.r_[heads, len(gram)])
            root = beside ^ cid
            mixed = np.minimum.reduceat(root, heads) < np.maximum.reduceat(root, heads)
            place = np.minimum(np.searchsorted(often, gram[heads].view(np.uint64)), max(0, len(often) - 1))
            hot = often[place] == gram[heads].view(np.uint64) if len(often) else np.zeros(len(heads), bool)
            size = np.where(hot, times[place], size) if len(often) else size
            keep = np.repeat(mixed | hot, np.diff(np.r_[heads, len(gram)]))
            rank = np.repeat(size, np.diff(np.r_[heads, len(gram)]))
            yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(cid[keep]), pa.array(rank[keep])], names=["gram", "cid", "times"])

    made = docs.where("id is not null").mapInArrow(prefixes, f"rep {kind}, cid bigint, rare array<bigint>, hot array<bigint>")
    rooted = materialised(few(classes.join(roots.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("cid", "rep", "n", F.coalesce("root", "cid").alias("root"))))
    prefix = made.join(rooted.select("cid", "rep", "root").hint("merge"), ["cid", "rep"]).dropDuplicates(["cid", "rep"])
    dealt = F.pmod(F.xxhash64("cid"), F.lit(SALTS)) + 1  # the rows of a frequent gram are dealt to many tasks
    both = F.concat(F.transform("rare", lambda g: F.struct(g.alias("gram"), F.lit(0).cast("long").alias("salt"))), F.transform("hot", lambda g: F.struct(g.alias("gram"), dealt.alias("salt"))))
    beside = F.col("root").bitwiseXOR(F.col("cid")).alias("beside")  # nil for most classes, so it packs well
    spread = prefix.select(F.explode(both).alias("g"), "cid", beside).select("g.gram", "cid", "beside", "g.salt")
    spread = spread.repartition("gram", "salt").drop("salt").sortWithinPartitions("gram").mapInArrow(shared_grams, "gram bigint, cid bigint, times bigint")
    smallest = F.floor((percent * F.col("n") + 99) / 100)  # of the sets that one of n may link with
    needed = (1 + F.floor(smallest / PER_SHARED)).cast("int")
    lists = spread.groupBy("cid").agg(F.collect_list(F.struct("times", "gram")).alias("shared"))
    able = lists.join(rooted.hint("merge"), "cid").where(F.size("shared") >= needed)
    rarest = F.slice(F.sort_array("shared"), F.lit(1), F.size("shared") - needed + 1)
    able = materialised(few(able.select("cid", "rep", "root", "n", F.transform(rarest, lambda g: g["gram"]).alias("grams"))))
    release(spark)

    # grams that still have several components; those of the largest one meet the others only
    members = able.select(F.explode("grams").alias("gram"), "cid", "root", "n")
    sides = members.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    members = materialised(few(members.join(sides.where("roots > 1").drop("roots").hint("merge"), "gram")))
    large = F.col("size") > PAIR_BLOCK
    zone = F.when(large, F.floor(F.log("n") / float(np.log(100 / percent * 1.01)))).otherwise(0).cast("int")
    placed = members.select("gram", "cid", "root", "n", "size", zone.alias("zone"), (large & (F.col("root") == F.col("top"))).alias("top"))
    cells = placed.where(large).groupBy("gram", "zone", "top").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    cells = materialised(few(cells.groupBy("gram").agg(F.collect_list(F.struct("zone", "top", "blocks")).alias("cells"))))  # written, so that the join splits a hot gram
    key = lambda z, t, b: F.struct(z.alias("zone"), t.alias("top"), b.alias("block"))
    mine = F.get(F.filter("cells", lambda c: (c["zone"] == F.col("zone")) & (c["top"] == F.col("top"))), F.lit(0))
    here = key(F.col("zone"), F.col("top"), F.pmod(F.xxhash64("cid"), F.coalesce(mine["blocks"], F.lit(1)).cast("long")).cast("int"))
    partners = F.filter("cells", lambda c: (F.abs(c["zone"] - F.col("zone")) <= 1) & ~(c["top"] & F.col("top")))
    others = F.flatten(F.transform(partners, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: key(c["zone"], c["top"], b))))
    met = placed.join(cells.hint("merge"), "gram", "left").select("gram", "cid", "root", "n", here.alias("here"), F.coalesce(others, F.array(here)).alias("others"))
    met = met.select("gram", "cid", "root", "n", "here", F.explode("others").alias("other"))
    met = met.select("cid", "root", "n", F.xxhash64("gram", F.least("here", "other"), F.greatest("here", "other")).alias("block"), (F.col("here") > F.col("other")).alias("second"), (F.col("here") == F.col("other")).alias("alone"))

    def describe_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_groups(*_unpacked(b.column(1).to_pylist()), words_in_gram))
            bits = [bitmap(s, width_of(len(s), *SENT_BITS)).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(bits, pa.binary())], names=["cid", "grams", "bits"])

    several = able.select("cid", "rep").join(members.select("cid").distinct().hint("merge"), "cid", "left_semi")
    whole = materialised(few(texts_of(several).select("cid", "text").mapInArrow(describe_sets, "cid bigint, grams binary, bits binary")))
    met = met.join(whole.select("cid", "bits").hint("merge"), "cid")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in _runs(batches, 1):
            root = t["root"].to_numpy()
            if len(root) < 2 or (root == root[0]).all():
                continue
            cid, bits = t["cid"].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t["bits"]]
            side = None if t["alone"][0].as_py() else t["second"].to_numpy().astype(int)
            for x, y in candidates(t["n"].to_numpy(), bits, percent, side):
                ok = root[x] != root[y]
                out += zip(np.minimum(cid[x[ok]], cid[y[ok]]).tolist(), np.maximum(cid[x[ok]], cid[y[ok]]).tolist(), strict=True)
                if len(out) > 1 << 16:
                    yield _pairs_out(list(set(out)))
                    out = []
        if out:
            yield _pairs_out(list(set(out)))

    def verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x, y) for x, y, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)]
            if found:
                yield _pairs_out(found)

    met = met.select("block", "cid", "root", "second", "alone", "n", "bits")
    possible = materialised(gathered(met.repartition("block").sortWithinPartitions("block").mapInArrow(pairs, "a bigint, b bigint").distinct()))
    side = lambda k, grams: _only(whole.select(F.col("cid").alias(k), F.col("grams").alias(grams)), k, possible, k)
    both = possible.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    more = materialised(gathered(both.mapInArrow(verify_pairs, "a bigint, b bigint")))
    dropped(able, members, cells, whole, possible, rooted)
    if not more.isEmpty():
        first = roots
        roots = components(first.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
        dropped(first)

    rooted = classes.join(roots.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    release(spark)
    least = materialised(few(rooted.groupBy("root").agg(F.min("rep").alias("component"))))  # written, so that the join splits a large component
    named = materialised(few(rooted.join(least.hint("merge"), "root").select("cid", "component")))
    dropped(more, roots, classes, least)
    out = own.join(named.hint("merge"), "cid", "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id")), [described, named]


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_gram: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each component, that of the least id; rows without an id or without words all stay."""
    made, read = _joined(df, id_col, text_col, words_in_gram, percent)
    found = made.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).groupBy(id_col).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows_"))
    found = materialised(few(found.where((F.col(id_col) != F.col("component_id")) | (F.col("rows_") > 1))))
    dropped(*read)
    release(df.sparkSession)
    bucket = next(n for n in ("bucket", *(f"bucket_{k}" for k in range(len(df.columns)))) if n not in df.columns)
    flags = F.broadcast(found.select(_bucket(id_col).alias(bucket)).distinct())  # at most BUCKETS
    dealt = df.withColumn(bucket, _bucket(id_col))
    settled = dealt.join(flags, bucket, "left_anti").select(*df.columns)
    open_ = dealt.join(flags, bucket, "left_semi").select(*df.columns)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    repeated = found.where((F.col(id_col) == F.col("component_id")) & (F.col("rows_") > 1)).select(id_col)
    left = open_.join(gone.hint("merge"), id_col, "left_anti").select(*df.columns)
    if repeated.isEmpty():
        return settled.unionByName(left)
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col]).select(*df.columns)
    return settled.unionByName(left.join(repeated, id_col, "left_anti").select(*df.columns)).unionByName(once)
