import math
import random

import numpy as np
import pyarrow as pa

from gritstone.llm import passages


def brute_windows(h, least):
    """Every stretch's place of the (leftmost) least hash, by looking at all of them."""
    return {(i, j): i + int(np.argmin(h[i : j + 1])) for i in range(len(h)) for j in range(i + least - 1, len(h))}


def test_windows_hold_each_stretch_once():
    rng = np.random.default_rng(0)
    for n, least, top in ((0, 3, 9), (2, 3, 9), (3, 3, 9), (30, 4, 1000), (30, 4, 3), (40, 1, 5)):
        h = rng.integers(0, top, n).astype(np.uint64)
        held = {}
        for l, c, r in zip(*passages.compact_windows(h, np.array([0, n]), least), strict=True):
            for i in range(l, c + 1):
                for j in range(max(c, i + least - 1), r + 1):
                    assert (i, j) not in held
                    held[i, j] = c
        assert held == brute_windows(h, least)


def test_windows_of_many_texts_at_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 30, 50)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 40, bounds[-1]).astype(np.uint64)
    alone = [
        (a + x, a + y, a + z) for a, b in zip(bounds, bounds[1:], strict=False) for x, y,
        z in zip(*passages.compact_windows(h[a:b], np.array([0, b - a]), 6), strict=True)
    ]
    assert sorted(zip(*passages.compact_windows(h, bounds, 6), strict=True)) == sorted(alone)


def test_keys_without_windows():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 30, 50)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for top in (1 << 60, 40, 4, 2):
        h = rng.integers(1, top, bounds[-1]).astype(np.uint64)
        keys = [{(int(h[k]), int(np.searchsorted(bounds, k, "right"))) for k in at} for at in (passages._roots(h, bounds, 6), passages.compact_windows(h, bounds, 6)[1])]
        assert keys[0] == keys[1] and (top < 1 << 60 or keys[0])


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for _ in range(50):
        hit = rng.random(30) < 0.6
        i, j = passages._longest(hit, 0.8)
        best = max((b - a for a in range(30) for b in range(a + 1, 31) if hit[a:b].mean() >= 0.8), default=0)
        assert j - i >= best - 8 and (j == i or hit[i] and hit[j - 1])


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def found(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df if parts is None else df.repartition(parts)
    return [tuple(r) for r in passages.repeated_passages(df).collect()]


def test_planted(spark):
    rng = random.Random(4)
    exact, near, short = words(rng, 60), words(rng, 120), words(rng, 40)
    edited = [w if k not in (30, 90) else "edit" for k, w in enumerate(near)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [
        (1, text(words(rng, 80), exact, words(rng, 30))),
        (2, text(exact, words(rng, 100))),
        (3, text(words(rng, 10), near, words(rng, 200))),
        (4, text(words(rng, 300), edited)),
        (5, text(words(rng, 50), short, words(rng, 50))),
        (6, text(words(rng, 70), short, words(rng, 20))),
        (7, text(words(rng, 400))),
        (8, None), (9, ""), (10, text(words(rng, 3))), (None, text(exact)),
    ]
    got = {(d, o): (a, b, c, e, s) for d, a, b, o, c, e, s in found(spark, rows)}
    assert got[2, 1] == (0, 60, 80, 140, 1.0)
    assert set(got) == {(2, 1), (4, 3)}
    a, b, c, e, s = got[4, 3]
    assert (a, b, c, e) == (300, 420, 10, 130) and s == (116 - 10) / (116 + 10)
    assert found(spark, []) == []


def test_many_copies_cost_a_row_each(spark):
    rng = random.Random(5)
    passage = words(rng, 70)
    rows = [(k, " ".join(words(rng, rng.randrange(5, 60)) + passage + words(rng, rng.randrange(5, 60)))) for k in range(300)]
    got = found(spark, rows)
    assert {r[0] for r in got} == set(range(1, 300))
    assert len(got) <= 2 * passages.FUNCTIONS * 300
    assert all(r[2] - r[1] >= 70 and r[6] >= 0.8 for r in got)


def test_passages_behind_a_phrase_of_many_documents(spark):
    rng = random.Random(6)
    phrase = words(rng, 45)  # too short for a passage; most of a passage's shingles, so that the least hashes are in it
    pair = [words(rng, 6) for _ in range(40)]
    rows = [(k, " ".join(words(rng, 60) + phrase + words(rng, 60))) for k in range(300)]
    rows += [(1000 + k + 500 * side, " ".join(words(rng, 30) + pair[k] + phrase + pair[k] + words(rng, 30))) for k in range(40) for side in (0, 1)]
    rng.shuffle(rows)
    got = {(r[0], r[3]) for r in found(spark, rows) if r[6] >= 0.8}
    assert {(1500 + k, 1000 + k) for k in range(40)} <= got


def test_passage_beside_a_repeated_line():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    tokens = lambda *parts: np.concatenate(parts)

    def shingled(w):
        return np.array([hash(tuple(w[k : k + 5].tolist())) & ((1 << 63) - 1) for k in range(len(w) - 4)], np.uint64)

    line, passage = fresh(20), fresh(60)
    edited = passage.copy()
    edited[30] = 1
    for copy, start in ((passage, 100), (edited, 100)):
        x, y = shingled(tokens(*[line] * 5, passage)), shingled(tokens(line, line, fresh(30), copy))
        got = passages.near_passages(x, y, 46, 0.8)
        assert any(i <= start and j >= start + 56 and k <= 70 and m >= 70 + 56 and s >= 0.8 for i, j, k, m, s in got), got


def test_every_verbatim_passage_of_two_documents(spark):
    rng = random.Random(21)
    rows = []
    for k in range(600):
        passage = words(rng, 80)
        rows += [(2 * k + side, " ".join(words(rng, 40) + passage + words(rng, 40))) for side in (0, 1)]
    assert {(2 * k + 1, 2 * k) for k in range(600)} <= {(r[0], r[3]) for r in found(spark, rows)}


def test_keys_of_two_nodes_with_the_same_bit(spark):
    held = [(np.array([5, 5, 9], np.uint64), np.array([1 << 10, 1 << 11, 1 << 10]))]
    assert passages._counted(held).to_pydict() == {"key": [5, 9], "node": [1024, 1024], "last": [2048, None], "bits": [1, None]}
    # texts whose hashes have the same topmost six bits
    rng, by_bits, rows = random.Random(22), {}, []
    passage = words(rng, 80)
    texts = [" ".join([*words(rng, 30), *passage, *words(rng, 30)]) for _ in range(40)]
    tops = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").selectExpr(
        "shiftrightunsigned(xxhash64(t), 58)").collect()]
    for k, top in enumerate(tops):
        by_bits.setdefault(top, []).append(k)
    pair = next(own for own in by_bits.values() if len(own) > 1)[:2]
    rows = [(k, texts[k]) for k in pair]
    assert [(r[0], r[3]) for r in found(spark, rows)] == [(pair[1], pair[0])]


def hot_corpus(rng, near):
    """150 pairs of passages, each of six 14-word phrases of which twelve passages share each: every key is hot. Where near, one word is changed."""
    phrases = [words(rng, 14) for _ in range(75)]
    rows, deal = [], [k for k in range(75) for _ in range(12)]
    rng.shuffle(deal)
    for k in range(150):
        passage = [w for p in deal[6 * k : 6 * k + 6] for w in phrases[p]]
        for side in (0, 1):
            own = list(passage)
            if near and side:
                own[rng.randrange(35, 50)] = "edit"
            rows.append((2 * k + side, " ".join(words(rng, 30) + own + words(rng, 30))))
    return rows


def test_recall_where_every_key_is_hot(spark):
    """At least 0.9 of near passages, and every verbatim one."""
    for seed in (23, 24):
        for near in (False, True):
            got = {(r[0], r[3]) for r in found(spark, hot_corpus(random.Random(seed), near))}
            share = sum((2 * k + 1, 2 * k) in got for k in range(150)) / 150
            print(seed, near, share)
            assert share >= 0.95 if near else share == 1.0


def pieces_corpus(rng, pairs):
    """Passages of 60 words, each in two documents, with another word in the middle of the one; and pieces of them, too short for a passage, in a dozen
    documents before these. So every key is hot, and what comes first beside it is a piece."""
    rows = []
    for _ in range(pairs):
        passage = words(rng, 60)
        for side in (0, 1):
            own = [w if k != 30 or not side else "edit" for k, w in enumerate(passage)]
            rows.append((10_000 + len(rows), " ".join(words(rng, 30) + own + words(rng, 30))))
    want = {(rows[k + 1][0], rows[k][0]) for k in range(0, 2 * pairs, 2)}
    passages_ = [t.split()[30:90] for _, t in rows[::2]]
    for passage in passages_:
        for start in (0, 6, 12, 18):
            rows += [(len(rows), " ".join(words(rng, 30) + passage[start : start + 42] + words(rng, 30))) for _ in range(12)]
    return rows, want


def test_near_passages_behind_first_pieces(spark):
    rows, want = pieces_corpus(random.Random(31), 12)
    got = {(r[0], r[3]) for r in found(spark, rows)}
    assert got == want


def test_hot_passages_as_brute_force(spark):
    """Documents of hot phrases, verbatim or with a word changed: those that brute force links are linked, whatever the order of ids."""
    rng = random.Random(32)
    phrases, rows = [words(rng, 30) for _ in range(5)], []
    for k in range(32):
        text = words(rng, 5)
        for p in rng.sample(phrases, 2):
            p = list(p)
            if rng.random() < 0.3:
                p[rng.randrange(30)] = f"edit{rng.randrange(3)}"
            text += p
        rows.append((k, " ".join(text + words(rng, 5))))
    want, up = brute_passages(rows), linked({(r[0], r[3]) for r in found(spark, rows)})
    assert len(want) == 20 and all(up[a] == up[b] for a, b in want)


def test_classes_of_many_near_copies(spark):
    """A passage with a word or two changed at random in each of 80 documents: all are linked, by fewer rows than pairs."""
    rng = random.Random(33)
    passage, rows = words(rng, 90), []
    for k in range(80):
        own = list(passage)
        for _ in range(rng.choice((1, 2))):
            own[rng.randrange(90)] = f"edit{k}"
        rows.append((k, " ".join(words(rng, 20) + own + words(rng, 20))))
    got = {(r[0], r[3]) for r in found(spark, rows)}
    assert linked(got) == linked({(k, 0) for k in range(1, 80)})
    assert len(got) < 80 * 79 / 2, len(got)


def test_linked_classes_make_no_more_pairs(spark, monkeypatch):
    """Similar classes of near copies are linked by a few pairs, not by each with each other one, and all documents still are."""
    rng, made, turned = random.Random(33), [], passages._turned

    def counted(both):
        made.append(turned(both).count())
        return turned(both)

    monkeypatch.setattr(passages, "_turned", counted)
    passage, rows = words(rng, 90), []
    for k in range(60):
        own = list(passage)
        for _ in range(rng.choice((1, 2))):
            own[rng.randrange(90)] = f"edit{k}"
        rows.append((k, " ".join(words(rng, 20) + own + words(rng, 20))))
    got = {(r[0], r[3]) for r in found(spark, rows)}
    assert linked(got) == linked({(k, 0) for k in range(1, 60)})
    assert made[1] < 60, made  # 3442 where all similar classes of different components were paired


def test_sets_of_classes_are_cut_out_before_they_are_sorted(spark, monkeypatch):
    """A long text with many classes is a run of 64 KB: what is sorted for each of its classes is its set alone."""
    rng, plans, save = random.Random(35), [], passages.save

    def planned(df, name, *more):
        if name == "similar":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, name, *more)

    monkeypatch.setattr(passages, "save", planned)
    passage, rows = words(rng, 90), []
    for k in range(40):
        own = list(passage)
        own[rng.randrange(90)] = f"edit{k}"
        rows.append((k, " ".join(words(rng, 20) + own + words(rng, 20))))
    assert found(spark, rows)
    sums = [line for line in plans[0].splitlines() if "Aggregate [" in line and "p_part" in line]
    assert sums and not any("substring" in line for line in sums), sums


def test_neighbours_of_runs():
    rng = np.random.default_rng(34)
    for _ in range(20):
        i, k, n = np.sort(rng.integers(0, 60, 20)), rng.integers(0, 60, 20), rng.integers(1, 9, 20)
        after, before = passages._neighbours(i, k, n, 8)
        for a in range(20):
            gaps = {b: (i[b] - i[a] - n[a], k[b] - k[a] - n[a]) for b in range(20) if i[b] > i[a] and k[b] > k[a]}
            gaps = {b: x + y for b, (x, y) in gaps.items() if -4 <= min(x, y) and max(x, y) <= 8}
            assert after[a] == min(gaps, key=gaps.get, default=-1)
            gaps = {b: (i[a] - i[b] - n[b], k[a] - k[b] - n[b]) for b in range(20) if i[b] < i[a] and k[b] < k[a]}
            gaps = {b: x + y for b, (x, y) in gaps.items() if -4 <= min(x, y) and max(x, y) <= 8}
            assert before[a] == min(gaps, key=gaps.get, default=-1)


def test_miss_probability():
    n, s = passages.FUNCTIONS, 0.8
    assert sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(passages.AGREE)) < 0.002


def shingled_text(t):
    w = (t or "").split()
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute_passages(rows, least=46, similarity=0.8):
    """Pairs of documents with a pair of stretches of exactly the least length that are similar enough: every pair of starts is looked at. Longer
    passages hold such ones, or are told by the exact check."""
    out = set()
    for k, (d, t) in enumerate(rows):
        for e, u in rows[:k]:
            x, y = shingled_text(t), shingled_text(u)
            if sum(p in set(y) for p in x) < least * similarity:
                continue
            for i in range(len(x) - least + 1):
                p = set(x[i : i + least])
                if any(len(p & q) / len(p | q) >= similarity for q in (set(y[j : j + least]) for j in range(len(y) - least + 1))):
                    out.add((max(d, e), min(d, e)))
                    break
    return out


def small_corpus():
    rng = random.Random(11)
    pool = [words(rng, rng.randrange(55, 90)) for _ in range(8)]
    phrase = words(rng, 30)
    rows = []
    for k in range(60):
        text = words(rng, rng.randrange(20, 60))
        for p in rng.sample(pool, rng.choice((0, 1, 1, 2))):
            p = list(p)
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            text += p + words(rng, rng.randrange(0, 20))
        rows.append((k, " ".join(text + (phrase if k % 3 == 0 else []))))
    return [*rows, (90, rows[3][1]), (91, rows[3][1]), (92, " ".join(["echo"] * 300)), (93, " ".join(["echo"] * 250))]


def linked(pairs):
    """The least document that each one is linked with."""
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_as_brute_force(spark):
    """All documents that share a passage are linked, and every row found is one."""
    rows = small_corpus()
    want, got = brute_passages(rows), found(spark, rows)
    text = dict(rows)
    for d, a, b, o, c, e, s in got:
        p, q = (set(shingled_text(" ".join(text[x].split()[i:j]))) for x, i, j in ((d, a, b), (o, c, e)))
        assert d > o and b - a >= 50 and e - c >= 50 and s == len(p & q) / len(p | q) >= 0.8
    mine = {(r[0], r[3]) for r in got}
    assert linked(want) == linked(want | mine) and linked(mine) == linked(want)


def test_same_rows_from_any_layout(spark):
    rows = small_corpus()
    one = sorted(found(spark, rows, 1))
    assert one == sorted(found(spark, rows, 16)) and one
    assert one == sorted(found(spark, [*rows, *rows[:20], rows[7]], 5))  # repeated rows count once


def test_windows_of_a_repeated_line_are_one():
    keys, doc = np.array([7, 7, 7, 7, 7, 7, 5, 7], np.uint64), np.array([0, 0, 0, 0, 0, 0, 0, 1])
    l, c, r = np.arange(8) * 10, np.arange(8) * 10 + 3, np.arange(8) * 10 + 9
    out = list(zip(*(x.tolist() for x in passages._spanned(keys, doc, l, c, r)), strict=True))
    assert out == [(5, 0, 60, 63, 69, False), (7, 0, 0, 3, 59, True), (7, 1, 70, 73, 79, False)]


def test_shared_keys_as_counted_one_by_one(spark):
    """Keys of several nodes, of either sign, in tasks or across them; they travel many to a row, and a filter lets few others through."""
    rng = np.random.default_rng(36)
    keys = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    held = {int(k): rng.integers(-(1 << 63), 1 << 63, n) for k, n in zip(keys, rng.choice((1, 1, 1, 2, 3, 40, 300), len(keys)), strict=True)}
    rows = [(k - (1 << 64) if k >> 63 else k, int(n)) for k, own in held.items() for n in own]
    rows = spark.createDataFrame(rows + rows[:1000], "k bigint, node bigint").repartition(5)

    def emit(batches):
        for batch in batches:
            yield batch.column("k").to_numpy().view(np.uint64), batch.column("node").to_numpy()

    shared = passages._shared(rows, emit, "test")
    bits = {k: len({int(n) >> 58 for n in own}) for k, own in held.items() if len({*own.tolist()}) > 1}
    assert {(r.key % (1 << 64), r.hot, r.many) for r in shared.collect()} == {(k, n > passages.MEET, n > passages.MANY) for k, n in bits.items()}
    every, hot = passages._filters(shared, "hot")
    assert passages._has(every, np.array([*bits], np.uint64)).all() and passages._has(hot, np.array([k for k, n in bits.items() if n > passages.MEET], np.uint64)).all()
    others = rng.integers(1, 1 << 63, 100_000).astype(np.uint64)
    assert passages._has(every, others).mean() < 0.03  # up to an eighth where a key set one bit of 8 to 16


def test_forest_links_what_its_edges_link():
    rng = np.random.default_rng(37)
    for n in (0, 1, 30, 300):
        u, v = rng.integers(0, 300, (2, n)).astype(np.uint64)
        p, q = passages._forest(u, v)
        assert len({*p.tolist()}) == len(p) and linked(zip(p.tolist(), q.tolist(), strict=True)) == {k: x for k, x in linked(
            zip(u.tolist(), v.tolist(), strict=True)).items() if k in {*p.tolist(), *q.tolist()}}
        assert len(p) == len({*u.tolist(), *v.tolist()}) - len({*linked(zip(u.tolist(), v.tolist(), strict=True)).values()})


def test_words_are_counted_in_their_texts():
    texts = ["", "a b", "c", "  x\ty \x0b", "é\x85ü z", None, "z", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(texts)], ["doc_id", "node", "text"])
    assert [n for b in passages._with_words(iter([batch])) for n in b.column("words").to_pylist()] == [0, 2, 1, 2, 2, 0, 1, 0]
