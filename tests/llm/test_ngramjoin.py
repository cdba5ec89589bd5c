import random
from collections import defaultdict

import numpy as np
import pytest

from gritstone.llm import ngramjoin


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """(doc_id, n, component) by comparing every pair that shares a shingle."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    holders, parent = defaultdict(list), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (d, s) in enumerate(sets):
        others = defaultdict(int)
        for g in s:
            for j in holders[g]:
                others[j] += 1
            holders[g].append(k)
        for j, shared in others.items():
            if 100 * shared >= percent * (len(s) + len(sets[j][1]) - shared):
                a, b = sorted((find(d), find(sets[j][0])))
                parent[b] = a
    return sorted((d, len(s), find(d) if s else d) for d, s in sets)


def result(spark, rows, size, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(tuple(r) for r in ngramjoin.jaccard_groups(df, size, percent).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, text, rate):
    return " ".join(w if rng.random() > rate else f"edit{rng.randrange(10**6)}" for w in text.split())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    make = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, base = make(60), make(120)
    texts = [make(rng.choice([1, 3, 10, 50, 200])) for _ in range(n)]
    texts += [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04])) for _ in range(n)]
    texts += [make(rng.choice([5, 20, 100])) + " " + passage for _ in range(n)]
    for _ in range(n):
        texts.append(edited(rng, rng.choice(texts), rng.choice([0, 0.01, 0.03])))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_as_brute_force(spark, size, percent):
    rows = corpus(size, 40)
    assert result(spark, rows, size, percent) == brute(rows, size, percent)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t "), (4, "one two"), (9, "ONE two"), (5, "one two three"), (6, "x " * 500), (7, "x " * 400), (8, "A b c d e f"),
        (8, "a b c d e f"), (10, "a b c d e f")
    ]
    assert result(spark, rows, 4, 85) == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 1, 6), (8, 3, 8), (8, 3, 8), (9, 1, 4), (10, 3, 8)
    ]
    assert result(spark, [], 4, 85) == []
    df = spark.createDataFrame([(None, "a b c d", "u"), (3, "a b c d", "v")], "doc_id bigint, text string, node string")
    assert sorted(tuple(r) for r in ngramjoin.jaccard_groups(df, 4, 85).collect() if r.doc_id) == [(3, 1, 3)]


def test_prefix_choice():
    assert ngramjoin.choose_prefix(np.zeros(100), 85) == (16, 1)
    frequent_first = np.concatenate([np.zeros(9), np.full(91, 1000.0)])
    assert ngramjoin.choose_prefix(frequent_first, 85) == (16, 1)
    length, m = ngramjoin.choose_prefix(np.full(100, 1000.0), 85)
    assert m > 1 and length == 15 + m
