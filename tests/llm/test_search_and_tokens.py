"""Ranked search, byte-pair encoding and the alignment of two tokenizers, held against brute force and the public libraries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gritstone.llm import align, bpe, pieces, queries, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=10):
    """item_id, rank, doc_id, score by the definition: every document for every item."""
    words = [(d, TERM.findall((t or "").translate(LOW))) for d, t in docs if d is not None]
    words = [(d, w) for d, w in words if w]
    whole, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked, out = defaultdict(set), []
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOW)))
    for i, terms in asked.items():
        scored = []
        for d, w in words:
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * whole) // length
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(rng, n=400, vocabulary=60):
    words = [f"{'Ab' if k % 7 == 0 else 'w'}{k}é" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    text = lambda size: "".join(w + rng.choice((" ", ", ", "\n", "_")) for w in rng.choices(words, weights, k=size))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(60)] + [(5, docs[3][1]), docs[7], docs[7], (900, None), (901, ""), (902, "!? _"), (None, docs[3][1])]
    rng.shuffle(docs)
    items = [(k, text(rng.randrange(1, 25))) for k in range(25)] + [(3, "w1é w2é"), (50, None), (51, "..."), (52, "nowhere"), (None, "W3É w3é w4é"), (53, docs[0][1])]
    return docs, items


def found(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(parts)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1))
    return sorted(map(tuple, treaps.search(d, q, **more).collect()), key=str)


def test_search_as_brute_force(spark, monkeypatch):
    docs, items = corpus(random.Random(1))
    want = brute_search(docs, items)
    assert found(spark, docs, items) == want and len(want) > 200
    monkeypatch.setattr(treaps, "BLOCK", 700)  # many blocks
    assert found(spark, docs, items, 7) == want
    monkeypatch.setattr(treaps, "TERMS", 60)  # several passes
    assert found(spark, docs, items, k=4) == brute_search(docs, items, 4)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


@pytest.mark.parametrize("ranges", [treaps.RANGES, 3])
def test_treaps_prune_and_stay_right(monkeypatch, ranges):
    monkeypatch.setattr(treaps, "RANGES", ranges)
    rng = np.random.default_rng(2)
    n = 3000
    rows = [(t, d) for t in range(12) for d in np.flatnonzero(rng.random(n) < 1 / (t + 1)).tolist()]
    term, doc = np.array(rows).T
    impact = rng.integers(1, 10**6, len(rows))
    impact[term == 3] = 5  # all equal, as in copies
    made = treaps.Treaps(term, doc, impact)
    depth = np.zeros(len(rows), int)
    for root in made.roots:  # heap and search order
        stack = [(root, -1, n, 1)]
        while stack:
            p, lo, hi, level = stack.pop()
            depth[p] = level
            assert lo < made.doc[p] < hi
            for child, a, b in ((made.left[p], lo, made.doc[p]), (made.right[p], made.doc[p], hi)):
                if child >= 0:
                    assert made.impact[child] <= made.impact[p]
                    stack.append((child, a, b, level + 1))
    assert depth.min() >= 1 and depth.max() < 60
    for _ in range(60):
        own = np.unique(rng.integers(0, 14, 5))
        total = np.zeros(n, np.int64)
        for t in own:
            np.add.at(total, doc[term == t], impact[term == t])
        want = [d for d in np.lexsort((np.arange(n), -total))[:10].tolist() if total[d] > 0]
        docs, scores, scored = made.best(own, 10)
        assert docs.tolist() == want and scores.tolist() == total[want].tolist() and scored < n


ODD = [None, "", " ", "\n\t ", "a", "Hello, WORLD's  end\n\n  x1234", "<|endoftext|>Hi<|startoftext|>", "naïve ﬁ Å é ΑΣ İ", "x" * 5000, "ab" * 3000, "the " * 4000, "日本語テキスト 😀👍🏽", "▁mark", "a\x1cb\x85c　d", "ᲉꟋ new letters", "end  "]


def texts(rng, n=200):
    letters = "aaabbctheing  \n\t'sdre<|>éñ中😀３!?."
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)] + ["ab" * 300000]


def encoded(spark, rows, model, **more):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("_ids", F.lit(0)).repartition(5)
    return [r.asDict() for r in bpe.encode(df, model, **more).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("path", "special"), [(queries.WORD_MERGES, True), (queries.BYTE_MERGES, True), (queries.BYTE_MERGES, False)])
def test_bpe_as_the_library(spark, path, special):
    rows = texts(random.Random(3))
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not special
    want = [library.encode(t or "", add_special_tokens=False).ids for t in rows]
    model = bpe.Bpe.load(path, special)
    got = encoded(spark, rows, model, packed=True, decoded=True)
    assert [r["_ids"] for r in got] == want
    assert [bytes(r["_packed"]) for r in got] == [np.array(w, "<u4").tobytes() for w in want]
    assert [r["_decoded"] for r in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    df = spark.createDataFrame([(0, want[5]), (1, []), (2, None), (3, [None, -1, 10**6, 5])], "k int, _ids array<int>")
    texts_ = [r.text for r in bpe.decode(df, model).orderBy("k").collect()]
    assert texts_ == [library.decode(want[5], skip_special_tokens=False), "", None, library.decode([5])]
    assert bpe.encode(df.selectExpr("'' AS text").limit(0), model).collect() == []


def test_pairs_tell_what_merging_gives():
    """A proposal is right where no pair of neighbours is crossed, and wrong where one is."""
    model, rng = bpe.Bpe.load(queries.WORD_MERGES), random.Random(4)
    names = [n for n in model.names if n.isascii() and n.isalpha() and len(n) < 6]
    for _ in range(3000):
        left, right = rng.choice(names), rng.choice(names)
        pair = [np.array([model.names.index(x)]) for x in (left, right)]
        atoms = model.atoms[[ord(c) for c in left + right]].tolist()
        whole = [model.merged(model.atoms[[ord(c) for c in x]].tolist()) == [int(k[0])] for x, k in zip((left, right), pair, strict=True)]
        if all(whole):
            assert bool(model.crossed(*pair)[0]) == (model.merged(atoms) != [int(k[0]) for k in pair])
    word = model.atoms[[ord(rng.choice("abcdeinot")) for _ in range(500)]].tolist()
    model.merged([0])
    assert model._long(list(word)) == model._short(list(word))


def brute_align(rows, a, b, a_bytes, b_bytes):
    """Groups and links from byte offsets; counts over all texts."""
    facts, holders = [], Counter()
    for t in rows:
        one, two = (a(" " + t), b(t)) if t else ([], [])
        joined = [b"".join(x) for x in ([a_bytes(k) for k in one], [b_bytes(k) for k in two])]
        if not t or joined != [(" " + t).encode()] * 2:
            facts.append(([], [], [], []))
            continue
        spans = []
        for ids, size in ((one, a_bytes), (two, b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(size(k)), k))
                at += len(size(k))
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append([[k for s, e, k in own if lo <= s and e <= c] for own in spans])
            lo = c
        links = [(k, m) for s, e, k in spans[0] for u, v, m in spans[1] if s < v and u < e]
        holders.update(set(links))
        facts.append((one, two, groups, links))
    best = defaultdict(int)
    for (k, _), n in holders.items():
        best[k] = max(best[k], n)
    text = lambda groups: ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
    return [(len(x), len(y), len(g), len(l), sum(holders[p] == best[p[0]] for p in l), sum(holders[p] for p in l), text(g)) for x, y, g, l in facts]


def test_align_as_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [t for t in texts(rng, 120) if len(t or "") < 3000]
    rows += [rows[5], rows[5], "word <|endoftext|> " + "the end. " * 40]
    library, model = Tokenizer.from_file(queries.BYTE_MERGES), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    library.encode_special_tokens = True
    letters, unit = bpe.byte_letters(), re.compile("<0x(..)>")
    a_bytes = lambda k: bytes(letters[c] for c in library.id_to_token(k))
    b_bytes = lambda k: bytes([int(m[1], 16)]) if (m := unit.fullmatch(model.id_to_piece(k))) else model.id_to_piece(k).replace("▁", " ").encode()
    want = brute_align(rows, lambda t: library.encode(t, add_special_tokens=False).ids, model.encode, a_bytes, b_bytes)
    one, two = bpe.Bpe.load(queries.BYTE_MERGES, special=False), pieces.Pieces.load(queries.PIECE_MODEL)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("_n_a", F.lit("x")).repartition(4)
    names = ["_n_a", "_n_b", "_n_groups", "_n_links", "_n_best", "_count_sum", "_groups"]
    got = [tuple(r[c] for c in names) for r in align.align(df, one, two).orderBy("doc_id").collect()]
    assert got == want and any(w[2] < min(w[0], w[1]) for w in want)
    monkeypatch.setattr(align, "TRAVELS", 300)  # counts go to tasks in several parts
    got = [tuple(r[c] for c in names) for r in align.align(df, one, two).orderBy("doc_id").collect()]
    assert got == want
    assert align.align(df.limit(0), one, two).collect() == []


def test_an_aligner_that_forgets(monkeypatch):
    """What it remembers has no say in what it finds."""
    one, two, rows = bpe.Bpe.load(queries.BYTE_MERGES, special=False), pieces.Pieces.load(queries.PIECE_MODEL), texts(random.Random(6), 60)[:-1]

    def facts(aligner, size):
        out = []
        for k in range(0, len(rows), size):
            which, bounds = aligner.read(rows[k : k + size])
            out += [[(aligner.groups[p], aligner.parts.arrays(np.array([p]))[0].tolist()) for p in which[i:j]] for i, j in zip(bounds, bounds[1:], strict=False)]
        return out

    want = facts(align.Aligner(one, two), 1000)
    monkeypatch.setattr(align, "PARTS", 30)
    monkeypatch.setattr(align, "STEPS", 20)
    assert facts(align.Aligner(one, two), 3) == want
    assert align.unpack(align.pack(np.array([7] * 70000 + [3], np.int64)))[1].tolist() == [1, 65535, 70000 - 65535]


def test_queries_digest_the_outputs(spark, tmp_path):
    rows = [(0, "The end of the world's news."), (1, None), (2, ""), (3, "▁ odd")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in queries.op12_bpe(spark, str(tmp_path)).collect()}
    ids = Tokenizer.from_file(queries.WORD_MERGES).encode(rows[0][1], add_special_tokens=False).ids
    assert (got[0].n_tokens, got[0].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert [(got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) for k in (1, 2)] == [(0, empty, empty)] * 2
    got = {r.doc_id: r for r in queries.op13_align(spark, str(tmp_path)).collect()}
    assert all(tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)) and len(got[0].groups_sha256) == 64
