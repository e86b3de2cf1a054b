import collections
import random

import numpy as np
import pytest

from strandlake.llm import ngram_join
from tests.llm.help import awkward, lower, words


def grams(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(rows, k, num, den):
    sets = [(i, grams(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for j, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                held[g].append(j)
    met = collections.Counter((a, b) for js in held.values() for n, b in enumerate(js) for a in js[:n])
    for (a, b), c in met.items():
        if den * c >= num * (len(sets[a][1]) + len(sets[b][1]) - c):
            x, y = top(sets[a][0]), top(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), top(i) if i is not None else None) for i, s in sets), key=repr)


def got(spark, rows, k, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(df, width=k, num=num, den=den).collect()), key=repr)


def near_copies(n, edits, seed):
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(400) for _ in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(40)
        rows.append((1000 * seed + i, " ".join(w[: rng.randint(85, 100)])))
    return rows


@pytest.mark.parametrize("k,num,den,settings", [
    (3, 90, 100, {}),
    (5, 80, 100, {"BLOCK": 16, "TASK_GRAMS": 1000}),
    (2, 50, 100, {"HOT_LEAST": 30, "TASK_GRAMS": 3000}),
    (3, 70, 100, {"HOT_LEAST": 2, "BLOCK": 8, "ROUNDS": 1}),
])
def test_against_all_pairs(spark, monkeypatch, k, num, den, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(120, 5, 1) + near_copies(40, 12, 2) + [(9000, None), (9001, ""), (9002, "a"), (9003, "A "), (9004, "a b"), (9005, " \n"), (9006, "x y z"), (9007, "X\ty\nz"), (9008, "x y z q")]
    assert got(spark, rows, k, num, den) == plain(rows, k, num, den)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements agree under every polynomial modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rows = [(10, f"one {a} two"), (11, f"one {b} two"), (12, f"one {a} two three"), (13, f"ONE {a} two")]
    assert got(spark, rows, 3, 90, 100) == plain(rows, 3, 90, 100)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 9])
def test_links_are_told_by_words(width):
    rng = random.Random(width)
    for _ in range(300):
        a, b = (" ".join(rng.choices(["a", "B", "c", "dd"], k=rng.randint(0, 14))) for _ in (0, 1))
        b = a + b if rng.random() < 0.5 else b
        x, y = grams(a, width), grams(b, width)
        assert ngram_join.linked(a.encode(), b.encode(), width, 60, 100) == bool(x and y and 100 * len(x & y) >= 60 * len(x | y))
    long = [" ".join(f"w{rng.randrange(9000)}" for _ in range(9000)) for _ in (0, 1)]
    assert ngram_join.linked(long[0].encode(), (long[0] + " x").encode(), width, 99, 100) and not ngram_join.linked(*(t.encode() for t in long), 5, 50, 100)


def test_frequent_ngrams_are_found(monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", 1000)
    monkeypatch.setattr(ngram_join, "HOTS", 50)
    rng = np.random.default_rng(1)
    found, every = ngram_join._Frequent(), []
    for _ in range(80):
        x = np.concatenate((rng.integers(0, 10**9, 200), rng.integers(0, 20, 30))).astype(np.uint64)
        every.append(x)
        found.add(x)
    found.add(np.zeros(0, dtype=np.uint64), last=True)
    count = collections.Counter(np.concatenate(every).tolist())
    held = dict(zip(found.gram.tolist(), found.n.tolist()))
    assert all(held.get(g, 0) > 0 for g, n in count.items() if n > 80 * 230 / 50) and all(n <= count[g] for g, n in held.items()) and len(held) <= 50


def test_awkward_rows(spark):
    rows = [(1, "a b c"), (1, "d e f"), (2, "a b c"), (3, "d e f"), (None, "a b c"), (4, "a b c " * 5000), (5, "A b c " * 5000)]
    assert got(spark, rows, 3, 90, 100) == plain(rows, 3, 90, 100)
    assert ngram_join.near_groups(awkward(spark).limit(0)).count() == 0
    out = ngram_join.one_of_each(awkward(spark))
    assert out.columns == awkward(spark).columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 6, 7, None], key=repr)


def test_sets_are_those_of_the_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "B", "c\x0b", "é", "dd", "\xa0"], k=rng.randint(0, 12))) for _ in range(300)]
    for k in (1, 3, 5):
        docs, hashes = ngram_join.shingle_sets([t.encode() for t in texts], k)
        assert np.bincount(docs, minlength=len(texts)).tolist() == [len(grams(t, k)) for t in texts]
        by = collections.defaultdict(set)
        for d, h in zip(docs.tolist(), hashes.tolist()):
            by[d].add(h)
        for a in range(0, 60):
            for b in range(a):
                assert len(by[a] & by[b]) == len(grams(texts[a], k) & grams(texts[b], k))


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 3000 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
