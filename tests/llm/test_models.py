import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from geolith.llm import decontamination, lm, ngram_join, quality
from geolith.llm.batches import text_buffer
from geolith.llm.queries import op4_quality


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- language model -----------------------------------------------------------

def plain_ppm(training, texts):
    """Method C with exclusion, one dictionary per context."""
    cls = lm.CONTEXT
    counts = [collections.defaultdict(collections.Counter) for _ in range(lm.DEPTH + 1)]

    def walk(text):
        data = [*(text or "").encode(), lm.END]
        classes = [int(lm._START)] * lm.DEPTH + [int(cls[b]) for b in data]
        for i, b in enumerate(data):
            context = tuple(classes[i : i + lm.DEPTH])
            yield context, b

    for t in training:
        for context, b in walk(t):
            for depth in range(lm.DEPTH + 1):
                counts[depth][context[lm.DEPTH - depth :]][b] += 1

    def probability(context, b):
        mass, seen = 1.0, set()
        for depth in range(lm.DEPTH, -1, -1):
            c = {s: n for s, n in counts[depth].get(context[lm.DEPTH - depth :], {}).items() if s not in seen}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b in c:
                return mass * c[b] / (n + d)
            mass *= d / (n + d)
            seen |= set(c)
        return mass / (256 - len(seen))

    return [sum(math.log10(probability(c, b)) for c, b in walk(t)) for t in texts], probability


TEXTS = ["The cat sat.", "the CAT\nran 12 times", "", None, "a cat é ran ran ran", "zebra ___ 漢字", "the the the", "dogs?"] * 3


def test_lm_matches_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT_PARTS", 12)  # some words are joined by shuffle
    rows = list(enumerate(TEXTS))
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    training = [t for k, t in rows if not held[k]]
    want, _ = plain_ppm(training, TEXTS)
    words = collections.Counter(w for t in training for w in [*split(t), None])
    n, v = sum(words.values()), len(words)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        tokens = [*split(t), None]
        assert got[k]["held_out"] == held[k] and got[k]["train_tokens"] == n and got[k]["n_tokens"] == len(tokens)
        assert got[k]["n_known"] == sum(words[w] > 0 for w in tokens)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert got[k]["score"] == pytest.approx(want[k], rel=1e-5)


def test_lm_contexts_are_whole_bytes(spark):
    """Digits, case and letters beyond ASCII tell what follows; so does the fourth byte back."""
    pairs = [("a7", "x", "y"), ("a8", "y", "x"), ("Qu", "x", "y"), ("qu", "y", "x"), ("кд", "x", "y"), ("кж", "y", "x"), ("K...", "x", "y"), ("L...", "y", "x")]
    trained = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 != 1][:80]
    rows = [(k, pairs[i % 8][0] + pairs[i % 8][1]) for i, k in enumerate(trained)]
    asked = [(before + right, before + wrong) for before, right, wrong in pairs]
    held = iter([k for k in range(2000, 4000) if zlib.crc32(str(k).encode()) % 5 == 1])
    both = [(next(held), t) for pair in asked for t in pair]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows + both, "doc_id long, text string")).collect()}
    for (right, _), (wrong, _) in zip(both[::2], both[1::2], strict=True):
        assert got[right] > got[wrong] + 0.5


def test_code_lengths_are_probabilities():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.05, (32**3, 256))
    counts[::3] = 0
    assert np.allclose((10.0 ** lm.code_lengths(counts).astype(float)).sum(axis=1), 1, atol=1e-3)


# -- quality ------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op4_quality(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[k]["score"], got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(p == y for _, p, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality.N_FEATURES)).astype(np.float32)
    owner = np.repeat(np.arange(20), 3)
    y = (x[::3, 0] > 0).astype(float)
    m = quality.fit(x, owner, y, epochs=200)
    p, a = quality.scores(m, x, owner, 20)
    assert ((p > 0.5) == (y > 0)).mean() > 0.9 and np.allclose(np.bincount(owner, a), 1)


def test_quality_scores_match_plain_version():
    rng = np.random.default_rng(4)
    x, owner = rng.normal(size=(40, quality.N_FEATURES)), np.sort(rng.integers(0, 9, 40))
    m = quality.fit(x, owner, (np.arange(9) % 2).astype(float), epochs=3)
    got, weight = quality.scores(m, x, owner, 9)
    for d in range(9):
        rows = [(v - m.mean) / m.scale for v, o in zip(x, owner) if o == d]
        if not rows:
            continue
        h = [np.tanh(r @ m.encode[:-1] + m.encode[-1]) for r in rows]
        e = [math.exp(float(np.tanh(v @ m.attend) * (1 / (1 + np.exp(-(v @ m.gate)))) @ m.focus)) for v in h]
        bag = sum(w / sum(e) * v for w, v in zip(e, h))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-float(bag @ m.decide[:-1] + m.decide[-1]))))
        assert weight[owner == d] == pytest.approx(np.array(e) / sum(e))


def test_passage_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["one two three " * 60, "", "THE END!! " * 30, "a | b | c\nd"]
    together, owner = quality.passages(*text_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        alone, _ = quality.passages(*text_buffer(pa.array([t])))
        assert np.allclose(together[owner == k], alone)


# -- decontamination ----------------------------------------------------------

def plain_alignment(item, doc):
    return plain_alignments(item, doc)[0]


def plain_alignments(item, doc):
    """Best score, and the most matches with it."""
    h = [[(0, 0)] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            add = lambda x, score, match=0: (x[0] + score, x[1] + match)
            h[i][j] = max((0, 0), add(h[i - 1][j - 1], 2, 1) if a == b else add(h[i - 1][j - 1], -1), add(h[i - 1][j], -1), add(h[i][j - 1], -1))
    return max(map(max, h))


def test_alignment_matches_plain_version():
    rng = random.Random(3)
    for k in range(200):
        item, doc = ([rng.randrange(4) for _ in range(rng.randint(1, 12 + k % 20))] for _ in range(2))
        got = decontamination.align(np.array(item, np.uint64), np.array(doc, np.uint64))
        assert (got.score, got.matches) == plain_alignments(item, doc)
        part = plain_alignments(item[got.item_start : got.item_end], doc[got.doc_start : got.doc_end]) if got.score else (0, 0)
        assert part == (got.score, got.matches)


def test_long_items_are_aligned_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    item = rng.integers(0, 1000, 5000).astype(np.uint64)
    doc = np.r_[rng.integers(0, 1000, 4000), np.delete(item, slice(0, 5000, 50)), rng.integers(0, 1000, 4000)].astype(np.uint64)
    tracemalloc.start()
    got = decontamination.align(item, doc)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert got.matches >= 4900 and got.doc_start >= 3990 and got.doc_end <= 8920


def test_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: text(rng.randint(12, 50)) for k in range(30)} | {90: ["only", "three", "words"], 91: []}
    docs, planted = {}, set()
    for k in range(120):
        body = text(200)
        if k % 3 == 0:
            item = rng.randrange(30)
            copy = list(items[item])
            if k % 2:  # changed, lost and inserted words
                for _ in range(len(copy) // 10):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
            at = rng.randrange(200)
            body[at:at] = copy
            planted.add((k, item))
        docs[k] = body
    docs[500] = [*text(50), "Only", "three,", "WORDS!", *text(50)]
    docs[501] = ["Only", "three,", "WORDS!", "here"]
    planted.add((501, 90))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    rows = decontamination.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    for r in rows:
        said = " ".join(docs[r["doc_id"]])[r["start"] : r["end"]].lower()
        assert items[r["item_id"]][r["item_start"]] == re.findall(r"\w+", said)[0]
    assert {r["doc_id"] for r in decontamination.decontaminated(d, b).collect()} == set(docs) - {k for k, _ in planted}


def test_edited_copies_are_found_as_by_brute_force(spark):
    """Items of every length with up to a fifth of their words changed, lost or inserted, among items that share their words."""
    rng = random.Random(5)
    text = lambda n: [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n)]
    items = {k: text(1 + k % 30) for k in range(90)}
    items[200] = [f"u{k}" for k in range(20)]
    items[201] = [f"v{k}" for k in range(9)]
    docs = {}
    for k in range(90):
        copy = list(items[k])
        for _ in range(rng.randint(0, -(-len(copy) // 5))):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[] if len(copy) > 1 else copy, ["new"], [copy[at], "more"]])
        docs[k] = [*text(15), *copy, *text(15)]
    docs[200] = [*text(9), *("new" if k % 5 == 4 else f"u{k}" for k in range(20)), *text(9)]  # every fifth word
    docs[201] = [*text(9), *("new" if k == 4 else f"v{k}" for k in range(9)), *text(9)]  # the middle one
    want = {(d, k): share for d, body in docs.items() for k, item in items.items() if len(item) >= decontamination.SHORT_WORDS and (share := plain_alignment(item, body) / (2 * len(item))) >= decontamination.SCORE}
    assert (200, 200) in want and (201, 201) in want
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == pytest.approx(want)


def test_blocks_of_the_benchmark_give_the_same(spark):
    """Seeds are as rare as they are in the whole benchmark, though its items share grams and are cut into blocks."""
    rng = random.Random(8)
    phrase = [f"p{k}" for k in range(6)]
    items = {k: [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 14))] + phrase * (k % 2) for k in range(30)}
    docs = {k: [*(f"w{rng.randrange(40)}" for _ in range(8)), *items[k % 30][: 4 + k % 9], *items[(k * 7) % 30]] for k in range(60)}
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    d, b = frame(docs, "doc_id"), frame(items, "item_id")
    plain = lambda f: sorted(map(str, f.collect()))
    whole = plain(decontamination.contaminated(d, b))
    assert whole and plain(decontamination.contaminated(d, b, block_bytes=400)) == whole
    assert plain(decontamination.decontaminated(d, b, block_bytes=400)) == plain(decontamination.decontaminated(d, b))
    every = decontamination.Benchmark(list(items), [" ".join(v) for v in items.values()])
    counts = collections.Counter(g for item, (n, found, _) in zip(*decontamination.item_grams([" ".join(v) for v in items.values()], 0.6)) for g in decontamination._distinct(item, n, found))
    seeds = lambda bench: {(n, int(h), bench.ids[i], int(q)) for n, (keys, first, item, place) in bench.seeds.items() for h, a, z in zip(keys, first[:-1], first[1:]) for i, q in zip(item[a:z], place[a:z])}
    parts = [decontamination.Benchmark([k], [" ".join(items[k])], counts=counts) for k in items]
    assert set().union(*map(seeds, parts)) == seeds(every)


def test_short_items_count_in_short_documents(spark):
    d = spark.createDataFrame([(1, "yes"), (2, "Yes, but"), (3, "yes " + "and more " * 20), (4, "only three words"), (5, "there are only three words in this text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "yes"), (2, "only three words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()} == {(1, 1), (2, 1), (4, 2)}


# -- n-gram join --------------------------------------------------------------

def plain_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = split(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in texts}


def near_copies(seed, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    texts, k = {}, 0
    for size in (3, 4, 5, 12, 40, 41, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += [rng.choice(vocabulary) for _ in range(rng.randint(1, 2 + size // 15))]
            texts[k] = " ".join(w)
            k += 1
    for _ in range(25):  # a passage that many documents share
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        texts[k] = " ".join(w[:10] + shared + w[10:])
        k += 1
    return texts | {k: None, k + 1: "", k + 2: "one", k + 3: "One", k + 4: "two words"}


@pytest.mark.parametrize("n, percent, small", [(4, 85, False), (5, 80, True)])
def test_components_match_brute_force(spark, monkeypatch, n, percent, small):
    if small:  # groups are split into blocks
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "PAIR_BLOCK", 3)
    texts = near_copies(n, 14)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, words_in_gram=n, percent=percent).collect()}
    assert got == plain_components(texts, n, percent)


def test_traversal_loses_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for size in (5, 30, 31, 33, 200, 230, 900):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(12):
            s = base.copy()
            s[rng.random(size) < rng.uniform(0, 0.12)] = rng.integers(0, 1 << 62)
            sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    for percent in (80, 85):
        found = {tuple(sorted((int(a), int(b)))) for x, y in ngram_join.candidates(sizes, [ngram_join.bitmap(s, ngram_join.width_of(len(s))) for s in sets], percent) for a, b in zip(x, y)}
        links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.linked(sets[i], sets[j], percent)}
        assert links <= found
        side = np.arange(len(sets)) % 2
        cross = {tuple(sorted((int(a), int(b)))) for x, y in ngram_join.candidates(sizes, [ngram_join.bitmap(s, ngram_join.width_of(len(s))) for s in sets], percent, side) for a, b in zip(x, y)}
        assert {p for p in links if (p[0] + p[1]) % 2} <= cross


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_one_of_each_group_stays(spark):
    texts = near_copies(9, 6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {k for k, (n, c) in plain_components(texts, 5, 80).items() if n == 0 or c == k}
    assert {r["doc_id"] for r in ngram_join.deduplicated(df).collect()} == want
