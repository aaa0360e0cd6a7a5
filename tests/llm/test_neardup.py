"""Near-duplicate classes against brute-force Jaccard similarity."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quillon.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes_by_hand(texts):
    sets = list({shingles(t) for t in texts})
    up = {s: s for s in sets}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    having = {}
    for s in sets:
        for x in s:
            having.setdefault(x, []).append(s)
    for a, b in {frozenset(p) for have in having.values() for p in combinations(have, 2)}:
        if 5 * len(a & b) >= 4 * len(a | b):
            up[root(a)] = root(b)
    return [root(shingles(t)) for t in texts]


def check(rows, found):
    """Rows (id, text) are parted into the same classes."""
    label = {r.id: r.label for r in found}
    want = dict(zip([k for k, _ in rows], classes_by_hand([t for _, t in rows]), strict=True))
    assert set(label) == set(want)
    pairs = {(label[k], want[k]) for k in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.fixture(scope="module")
def edited():
    """Copies with few changed words of some texts, many of one; a passage that many other texts share; short and odd texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(30):
        base = rng.choices(words, k=rng.choice([8, 40, 120, 400]))
        for _ in range(60 if k == 0 else rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    passage = rng.choices(words, k=60)
    texts += [" ".join(rng.choices(words, k=20) + passage + rng.choices(words, k=20)) for _ in range(60)]
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", "a" * 20_000, " ".join(words * 20), " ".join(words * 20) + " end"]
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1024, 16])
def test_classes_equal_brute_force(spark, edited, chunk):
    df = spark.createDataFrame(edited, "doc_id long, text string")
    prints, classes = neardup.near_duplicate_classes(df, chunk)
    check(edited, prints.join(classes, "s").collect())


def test_classes_of_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    prints, classes = neardup.near_duplicate_classes(df)
    check([(r.doc_id, r.text) for r in df.collect()], prints.join(classes, "s").collect())


def families(n_families, size, n_words, seed=8):
    """Copies of texts, each with 2 or 3 words changed, so that many pairs lie just below the least similarity."""
    rng = random.Random(seed)
    texts = []
    for f in range(n_families):
        base = [f"f{f}w{i}" for i in range(n_words)]
        for c in range(size):
            copy = list(base)
            for x in rng.sample(range(n_words), rng.choice([2, 3])):
                copy[x] = f"c{f}.{c}.{x}"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1024, 24])
def test_no_link_is_lost_near_the_threshold(spark, chunk):
    rows = families(6, 80, 200)
    prints, classes = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), chunk)
    check(rows, prints.join(classes, "s").collect())


@pytest.mark.parametrize("chunk", [1024, 64])
def test_a_key_of_many_different_documents(spark, chunk):
    """A passage in many otherwise different texts puts them under the same keys; a few are near copies of each other."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + rng.choices(words, k=40) for _ in range(900)]
    texts += [[*t[:-1], "x"] for t in texts[:60]]
    rows = list(enumerate(" ".join(t) for t in texts))
    prints, classes = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), chunk)
    check(rows, prints.join(classes, "s").collect())


def test_cross_pairs_are_all_pairs_between_two_groups():
    from quillon.llm.simhash import cross_pairs

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, (150, 2), dtype=np.uint64)
    y = np.concatenate([x[:70] ^ (np.uint64(1) << rng.integers(0, 63, (70, 2), dtype=np.uint64)), rng.integers(0, 1 << 63, (31, 2), dtype=np.uint64)])
    got = set(zip(*(c.tolist() for c in cross_pairs(x, y, 9)), strict=True))
    apart = lambda a, b: sum(int(p ^ q).bit_count() for p, q in zip(a, b, strict=True))
    assert got == {(i, j, d) for i in range(150) for j in range(101) if (d := apart(x[i], y[j])) <= 9}
    assert len(cross_pairs(x[:0], y, 9)[0]) == 0


def test_one_of_each_class_stays(spark, edited):
    rows = [(k, t, k, "s", 1, True) for k, t in edited] + [(None, "one two", 1, "s", 1, True), (3, "one two", 2, "s", 1, True), (3, "one two", 2, "s", 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k long, s string, n long, stays boolean")
    kept = neardup.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    names = classes_by_hand([r[1] for r in rows])
    assert len(got) == len(set(names)) and Counter(classes_by_hand([r.text for r in got])).most_common(1)[0][1] == 1
    least = {}
    for (k, *_), c in zip(rows, names, strict=True):
        least[c] = min(least.get(c, (True, 1 << 60)), (k is not None, k or 0))
    assert {(r.doc_id is not None, r.doc_id or 0) for r in got} == set(least.values())


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y z", 0.5)] * 5, "doc_id long, text string, id double")
    assert [tuple(r) for r in neardup.keep_one_of_each(df).collect()] == [(1, "x y z", 0.5)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.keep_one_of_each(empty).count() == 0


def test_closest_tree_connects_and_prefers_near_pairs():
    rng = np.random.default_rng(1)
    n = 60
    i, j = np.triu_indices(n, 1)
    use = rng.random(len(i)) < 0.06
    i, j = i[use], j[use]
    d = rng.integers(0, 70, len(i))
    tree = neardup.closest_tree(n, i, j, d)
    links = neardup.closest_links(i, j, d)
    step = {frozenset(p): int(np.searchsorted(neardup.STEPS, w)) for *p, w in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
    assert len({v for v, _ in tree}) == len(tree) == len(links)
    assert sorted(step[frozenset(e)] for e in tree) == sorted(step[frozenset(e)] for e in links)
    dense = neardup.closest_tree(n, *np.triu_indices(n, 1), np.full(n * (n - 1) // 2, 9))
    assert sorted(dense) == [(v, 0) for v in range(1, n)]


def test_components_of_random_graphs(spark):
    from quillon.llm.components import connected_components

    rng = random.Random(9)
    graphs = [[(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)], [(i, 99) for i in range(50)], [(5, 5)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]]
    edges = [(1000 * g + a, 1000 * g + b) for g, own in enumerate(graphs) for a, b in own]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted((x, root(x)) for x in up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
