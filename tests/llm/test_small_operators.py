"""Edges and brute force of the operators that are not pairs of documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from gritstone.llm import ann, gru, imatch, linededup, lm, mixing, ngramjoin, passages, pieces, quality, urlfilter
from gritstone.llm.components import components
from gritstone.llm.queries import PIECE_MODEL, URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \t\n", "one", "é à ü " * 3, "x" * 5000, "word " * 3000, "same text here\nsame text here"]


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)]
    return [*rows, rows[3], (3, "another text", "en", "s", 1), (None, "no id", "en", "s", 1), (50, ODD[6], "en", "s", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n=80):
    return " ".join(rng.choice(("the", "of", "to")) + rng.choice((" ", ", ", ". ")) + rng.choice("abcdefghij") * rng.randrange(2, 7) for _ in range(n))


# fingerprints


def test_imatch_edges(spark):
    got = imatch.fingerprint_edits(frame(spark, odd_rows()).withColumn("version", F.lit(1))).collect()
    assert len(got) == len(odd_rows())
    same = {r.doc_id: r for r in got if r.doc_id in (6, 50)}
    assert same[6].fingerprint == same[50].fingerprint and same[6].n_chars == 15000
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).n_chars == 5
    assert imatch.fingerprint_edits(frame(spark, [])).collect() == []


def test_imatch_next_ids(spark):
    ids = spark.createDataFrame([(k,) for k in (5, -3, 900, 17)], "doc_id bigint")
    assert {r.doc_id: r.next_id for r in imatch.next_ids(ids).collect()} == {-3: 5, 5: 17, 17: 900, 900: -3}


def test_imatch_lexicon_by_shuffle_is_the_same(spark):
    rng = random.Random(0)
    docs = frame(spark, [(k, prose(rng), None, None, None) for k in range(60)]).select("doc_id", "text")
    words = imatch.lexicon(docs, (0.02, 0.9))
    near, far = (imatch.fingerprints(docs, ["doc_id"], "text", w, "f").collect() for w in (F.broadcast(words), words.hint("merge")))
    assert {r.doc_id: r.f for r in near} == {r.doc_id: r.f for r in far}


# quality


def test_quality(spark):
    rng = random.Random(1)
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|", "X9%%"]) for _ in range(60))
    rows = [(k, prose(rng) if k % 3 else junk(), "en", "s", 1) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 240, 2)] + [(1, None), (None, 1), (7, 5)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), labels).collect()}
    held = [k for k in range(1, 240, 2)]
    assert sum((got[k].score > 0.7) == (k % 3 > 0) for k in held) >= 0.98 * len(held)
    kept = quality.without_rejected(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and abs(kept.count() - 160) <= 3


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    got = quality.classify(frame(spark, odd_rows()).withColumn("score", F.lit(1)), labels).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    assert quality.without_rejected(frame(spark, odd_rows()), labels).count() == len(odd_rows())
    assert quality.classify(frame(spark, []), labels).collect() == []


# pieces


def test_pieces_as_the_library(spark):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), random.Random(2)
    texts = ["", "   ", " a  b ", "Hello\n\tworld é 漢字 😀", "x" * 300, "12345 67", "aaaaaaa aaaa a", *[prose(rng) for _ in range(20)]]
    texts += ["".join(rng.choice("abc \né=😀_") for _ in range(60)) for _ in range(60)]
    own = pieces.Pieces.load(PIECE_MODEL)
    ids, bounds = pieces.Encoder(own).encode(texts)
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t) and own.decode(ids[a:b].tolist()) == t


def test_pieces_unigram_is_the_best_sum():
    names = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba", "aba"]
    scores = [0.0, -2.0, -3.0, -3.5, -4.0, -6.5, -4.2, -7.0]
    own = pieces.Pieces(names, scores, ["unknown"] + ["normal"] * 7, unigram=True)
    for text in ("ab", "abab", "bbaab"):
        ids, _ = pieces.Encoder(own).encode([text])
        whole = "▁" + text
        best = {0: 0.0}
        for j in range(1, len(whole) + 1):
            best[j] = max(best[i] + own.score[whole[i:j]] for i in range(j) if whole[i:j] in own.id)
        assert math.isclose(sum(scores[k] for k in ids), best[len(whole)]) and "".join(names[k] for k in ids) == whole


def test_pieces_edges(spark):
    own = pieces.Pieces.load(PIECE_MODEL)
    out = pieces.encode(frame(spark, odd_rows()).withColumn("_exact", F.lit(3)), own, check=True)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and all(r._exact for r in rows)
    assert all(r._ids == [] for r in rows if not r.text)
    back = pieces.decode(out.select("doc_id", "_ids", F.col("text").alias("was")), own).collect()
    assert all(r.text == (r.was or "") for r in back)
    assert pieces.encode(frame(spark, []), own).collect() == []


def plain_statistics(text):
    """The statistics of quality.STATISTICS and the number of words, a character at a time."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw)) if w]
    lines = raw.split(b"\n")
    chars, n = len(raw), len(words)
    rate = lambda part, whole: math.log((part + 0.002 * whole + 0.25) / (whole + 5))
    count = lambda test: rate(sum(1 for c in raw if test(c)), chars)
    n1 = max(n, 1)
    made = {
        "word_length": math.log1p(sum(map(len, words)) / n1), "capitals": count(lambda c: 65 <= c <= 90), "digits": count(lambda c: 48 <= c <= 57), "symbols": count(lambda c: chr(c) in "!#$%&*@^~+=<>{}[]\\/_"),
        "bars": count(lambda c: c == ord("|")), "accents": count(lambda c: c >= 128), "stops": count(lambda c: chr(c) in ".,;:?"), "distinct_words": math.log((len(set(words)) + 5) / (n1 + 5)) / math.log(n1 + 10),
        "repeated_next": rate(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), "top_word": rate(max(Counter(words).values(), default=0), n),
        "distinct_lines": math.log((len({x.strip() for x in lines} - {b""}) + 1) / (len(lines) + 1)), "line_words": math.log1p(n / len(lines)),
    }
    return [made[name] for name in quality.STATISTICS], n


def plain_scores(rows, labels):
    """doc_id's scores by inverse covariances and determinants. rows: (doc_id, text); labels: doc_id to 0 or 1."""
    x, words = map(np.array, zip(*[plain_statistics(t) for _, t in rows], strict=True))
    known = [(k, labels[d]) for k, (d, _) in enumerate(rows) if labels.get(d) in (0, 1)]
    at, y = np.array([k for k, _ in known]), np.array([q for _, q in known])
    centre = x[at].mean(0)
    z = centre + (x - centre) * (words / (words + 30.0))[:, None]
    cov = [np.cov(z[at[y == c]].T, bias=True) for c in (0, 1)]
    share = [(y == c).mean() for c in (0, 1)]
    pooled = sum(w * c for w, c in zip(share, cov, strict=True))
    logs = []
    for c in (0, 1):
        m = 0.9 * cov[c] + 0.1 * pooled
        m = 0.95 * m + 0.05 * np.diag(np.diag(m)) + 1e-6 * np.eye(len(m))
        d = z - z[at[y == c]].mean(0)
        logs.append(math.log(share[c]) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d) - 0.5 * np.linalg.slogdet(m)[1])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_quality_as_brute_force(spark):
    rng = random.Random(12)
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|", "X9%%", "éà"]) for _ in range(rng.randrange(5, 60)))
    rows = [
        (k, prose(rng, rng.randrange(5, 60)) + "\n" * (k % 4) + prose(rng, 9) if k % 3 else junk()) for k in range(90)
    ] + [(200 + k, t) for k, t in enumerate(ODD)]
    x, n = quality.statistics(pa.array([t for _, t in rows], pa.string()))
    assert np.allclose(x, [plain_statistics(t)[0] for _, t in rows], atol=1e-9) and n.tolist() == [plain_statistics(t)[1] for _, t in rows]
    labels = {k: int(k % 3 > 0) if k % 10 else 1 for k in range(90)} | {3: None, 6: 7}
    got = {
        r.doc_id: r.score for r in quality.classify(
            frame(spark, [(d, t, None, None, None) for d, t in rows]), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")
        ).collect()
    }
    assert np.allclose([got[d] for d, _ in rows], plain_scores(rows, labels), atol=1e-7)


def test_nulls_stay_null(spark):
    rows = [
        (k, prose(random.Random(k), 40) if k % 2 else "X! $$ " * 20, "en", "s", 1) for k in range(40)
    ] + [(100, None, None, None, None), (101, "", None, None, None)]
    df = frame(spark, rows)
    assert {r.doc_id: r.text for r in pieces.encode(df, pieces.Pieces.load(PIECE_MODEL)).where("doc_id > 99").collect()} == {100: None, 101: ""}
    kept = quality.without_rejected(df, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int"), threshold=0.0).collect()
    assert {r.doc_id: r.text for r in kept if r.doc_id > 99} == {100: None, 101: ""} and len(kept) == len(rows)


def plain_imatch(rows, band=(0.001, 0.05)):
    """Fingerprints by doc_id of texts and edited texts."""
    order = sorted(rows)
    words = lambda t: {w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w}
    df = Counter(w for _, t in rows for w in words(t))
    kept = {w for w, c in df.items() if max(1, band[0] * len(rows)) <= c <= max(1, band[1] * len(rows))}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def fingerprint(t):
        h = sorted(int(md5(w)[:15], 16) for w in words(t) & kept)
        text = lambda values: md5(" ".join(map(str, values)))
        out = [text(h)[:16] if h else md5(" ".join(sorted(words(t))))[:16]]
        groups = [[x for x in h if x & 3 == a and x >> 2 & 3 == b] for a in range(4) for b in range(4)]
        groups += [[x for x in h if x >> 4 & 3 == 0 and x >> 6 & 15 == b] for b in range(16)]
        groups += [[x for x in h if x >> 10 & 7 == 0 and x >> 13 & 31 == b] for b in range(32)]
        return ".".join(out + [text(g)[:8] if g else "" for g in groups])

    def near(a, b):
        pairs = [p for p in zip(a.split("."), b.split("."), strict=True) if any(p)]
        return sum(x == y for x, y in pairs) / len(pairs)

    out = {}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other = fingerprint(t), fingerprint(edited)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, round(near(own, other), 9), round(near(own, fingerprint(after)), 9))
    return out


def test_imatch_as_brute_force(spark):
    rng = random.Random(13)
    rows = [(k, prose(rng, rng.randrange(3, 90)) + f" own{k} Pair{k // 2}") for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)]
    for band in ((0.001, 0.05), (0.02, 0.5)):
        got = {
            r.doc_id: (
                r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)
            ) for r in imatch.fingerprint_edits(frame(spark, [(d, t, None, None, None) for d, t in rows]), band).collect()
        }
        assert got == plain_imatch(rows, band)


def test_texts_longer_than_a_slice(spark):
    """A text of over a MiB and its copy, in every operator that reads texts."""
    rng = random.Random(14)
    long = "\n".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(12)) for _ in range(18000))
    assert len(long) > 1 << 20
    rows = [(1, long, "en", "a", 1), (2, long, "en", "b", 1), (3, "a short text of a few words", "en", "a", 1), (4, None, None, None, None)]
    df = frame(spark, rows)
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == {1: long, 2: "", 3: rows[2][1], 4: None}
    assert [tuple(r)[:6] for r in passages.repeated_passages(df).collect()] == [(2, 0, len(long.split()), 1, 0, len(long.split()))]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r.doc_id: r for r in pieces.encode(df, pieces.Pieces.load(PIECE_MODEL), check=True).collect()}
    assert list(got[1]._ids) == library.encode(long) and got[1]._exact and got[4]._ids == []
    prints = {r.doc_id: r for r in imatch.fingerprint_edits(df).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint and prints[1].n_chars == len(long)
    assert {r.doc_id: r.n_tokens for r in lm.score(df, F.lit(True)).collect()} == {1: len(long.split()) + 1, 2: len(long.split()) + 1, 3: 8, 4: 1}
    assert quality.classify(df, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 4
    assert {len(r.text or "") for r in mixing.mix_sources(df, total=40.0).collect()} <= {len(long), len(rows[2][1]), 0}
    assert urlfilter.judge(
        spark.createDataFrame([(1, "http://a.org/" + long), (2, "x" * (2 << 20))], "page_id bigint, url string"),
        spark.createDataFrame([], "page_id bigint, good int"), URL_RULES
    ).count() == 2


# line dedup


def plain_patience(a, b, i=0, j=0):
    """Patience alignment by recursion, the longest rising run by the square of its length; of equal runs the one that ends with the last pair, and
    goes back by the last ones."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *plain_patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    pairs = [(p, b.index(x)) for p, x in enumerate(a) if a.count(x) == b.count(x) == 1]
    if not pairs:
        nth = lambda rows: [(x, rows[:k].count(x)) for k, x in enumerate(rows)]
        pairs = [(p, nth(b).index(x)) for p, x in enumerate(nth(a)) if x in nth(b)]
    best = []
    for k, (_, q) in enumerate(pairs):
        best.append(1 + max((best[h] for h in range(k) if pairs[h][1] < q), default=0))
    run, n = [], max(best, default=0)
    for k in range(len(pairs) - 1, -1, -1):
        if n and best[k] == n and (not run or pairs[k][1] < run[-1][1]):
            run.append(pairs[k])
            n -= 1
    out, edges = [], [(-1, -1), *run[::-1], (len(a), len(b))]
    if not run:
        return []
    for (p, s), (q, t) in zip(edges, edges[1:], strict=False):
        out += plain_patience(a[p + 1 : q], b[s + 1 : t], i + p + 1, j + s + 1)
        out += [(i + q, j + t)] * (q < len(a))
    return out


def test_patience():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice([1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(0, 12))]
        b = [x for x in a if rng.random() < 0.7] + [rng.randrange(5, 12)]
        rng.random() < 0.3 and rng.shuffle(b)
        out = linededup.patience(a, b)
        assert out == plain_patience(a, b)
        assert all(a[i] == b[j] for i, j in out) and all(p < r and q < s for (p, q), (r, s) in zip(out, out[1:], strict=False))
        assert linededup.patience(a, a) == [(k, k) for k in range(len(a))]
    assert linededup.patience([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]


def brute_lines(rows, least=20):
    """The same rule, document by document, with an alignment of its own."""
    lines = {d: [x.strip(" ") for x in (t or "").split("\n")] for d, t in rows}
    long = {d: {x for x in v if len(x) >= least} for d, v in lines.items()}
    held = Counter(x for v in long.values() for x in v)
    first = {x: min(d for d in long if x in long[d]) for x in held}

    def blocks(kept, own):
        out, run = set(), []
        pairs = plain_patience(kept, own)
        for k, (i, j) in enumerate(pairs):
            run = [*run, j] if k and (i - 1, j - 1) == pairs[k - 1] else [j]
            if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
                out |= set(run) if any(len(own[x]) >= least for x in run) else set()
        return out

    gone, done, open_ = {d: set() for d in lines}, {d: set() for d in lines}, {d: {x for x in long[d] if first[x] < d} for d in lines}
    for turn in range(3):
        keeper = first if turn < 2 else {x: min(d for d in lines if x in open_[d]) for x in {x for v in open_.values() for x in v}}
        now = {}
        for d in lines:
            rare = min((held[x] for x in open_[d]), default=0)
            partners = {keeper[x] for x in open_[d] if turn or held[x] == rare} - done[d] - {d}
            done[d] |= partners
            now[d] = set().union(*[blocks(lines[p], lines[d]) for p in partners if p < d])
        for d in lines:
            gone[d] |= now[d]
            open_[d] -= {lines[d][j] for j in now[d]}
    return {d: t if not gone[d] else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) for d, t in rows}


def test_line_dedup_as_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line number {k} of the pool of lines" for k in range(40)]
    rows = [
        (
            k, "\n".join(rng.choice([rng.choice(pool), f"own line {rng.random()} of a document", "short", ""]) for _ in range(rng.randrange(1, 9)))
        ) for k in range(80)
    ]
    rows += [(100 + k, rows[5][1]) for k in range(150)]
    data = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = {r.doc_id: r.text for r in linededup.dedup_lines(data).collect()}
    assert got == brute_lines(rows)
    short = {r.doc_id: r.text for r in linededup.dedup_lines(data, least_chars=5).collect()}
    assert short == brute_lines(rows, 5) and sum(map(len, short.values())) < sum(map(len, got.values()))


def test_line_dedup_frequent_and_moved_lines(spark):
    """A passage that a third of the documents hold goes from those that also share a rarer line, and a block goes whose lines stand in another order
    in their first document."""
    hot, rare = "a line that a third of all documents hold", "a line that only two documents hold"
    a, b = "the first line of a moved block", "the second line of a moved block"
    rows = [(k, f"{hot}\nown line {k} of a document" if k % 3 == 0 else f"own line {k} of a document") for k in range(30)]
    rows += [
        (40, f"{rare}\nxyz"), (41, f"{rare}\n{hot}\nabc"), (50, f"{b}\n{a}"), (51, f"{a}\n{b}\nkept line of the second document"),
        (52, f"{a}\n{b}\nkept line of the third document")
    ]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, [(d, t, None, None, None) for d, t in rows])).collect()}
    assert got[41] == "abc" and got[3] == "own line 3 of a document" and got[0] == rows[0][1]
    assert got[52] == "kept line of the third document" and got == brute_lines(rows)


def test_line_dedup_edges(spark):
    rows = odd_rows()
    got = linededup.dedup_lines(frame(spark, rows).withColumn("_lines", F.lit("x"))).collect()
    assert len(got) == len(rows) and {r._lines for r in got if r.text is None} == {0}
    assert [r.text for r in got if r.doc_id == 50] == [""] and [r.text for r in got if r.doc_id is None] == ["no id"]
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


# nearest neighbours


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.2 * rng.standard_normal((4000, 16))).astype(np.float32)
    x[100:400] = x[100]  # one vector many times
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [
        (5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] + [1.0] * 14), (5400, [1.0]), (None, [1.0] * 16)
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("part", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 4000, 100))
    hits = 0
    for q, rows in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(4000), d))[:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & set(best.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[100]] == list(range(101, 111))


def recall(x, got, queries, k=10):
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got.get(q, set()) & set(np.lexsort((np.arange(len(x)), d))[:k].tolist()))
    return hits / k / len(queries)


def test_ann_recall_with_many_parts(spark, monkeypatch):
    """24,000 vectors in 24 parts; and the same with parts that are cut again."""
    rng = np.random.default_rng(6)
    basis = rng.standard_normal((6, 24))
    x = (rng.standard_normal((24000, 6)) @ basis + 0.3 * rng.standard_normal((24000, 24))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(8).cache()
    for most in (256, 6):
        monkeypatch.setattr(ann, "MOST_PARTS", most)
        got = {}
        for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert recall(x, got, range(0, 24000, 100)) >= 0.9


def test_ann_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(df.where("false"), F.lit(True)).collect() == []


# language model


def test_gru_probabilities_and_gradients():
    rng = np.random.default_rng(6)
    model = gru.Model.start(rng.integers(1, 9, gru.VOCABULARY).astype(float))
    h = rng.standard_normal((3, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.VOCABULARY)
    p = np.exp(np.array([model.log_probability(np.repeat(h[k : k + 1], len(every), 0), every) for k in range(3)], float)).sum(1)
    assert np.allclose(p, 1, atol=1e-4)
    ids = rng.integers(0, gru.VOCABULARY, 700)
    bounds = np.array([0, 5, 5, 200, 700])
    whole = gru.score_documents(model, ids, bounds, 0, lanes=4, steps=7)
    for d in range(4):
        own = ids[bounds[d] : bounds[d + 1]]
        alone = 0.0
        if len(own):
            hidden, _ = model.window(np.concatenate([[0], own[:-1]])[:, None], np.ones((len(own), 1), np.float32), np.zeros((1, gru.HIDDEN), np.float32))
            alone = model.log_probability(hidden, own).sum()
        assert math.isclose(whole[d], alone, rel_tol=1e-4, abs_tol=1e-3)
    text = np.tile(np.arange(20), 400)
    before = gru.score_documents(model, text, np.array([0, len(text)]), 0)[0]
    trainer = gru.Trainer(model)
    starts = np.zeros(len(text), bool)
    starts[0] = True
    for _ in range(3):
        gru.train_on(trainer, text, starts, 0, lanes=16, steps=10)
    assert gru.score_documents(model, text, np.array([0, len(text)]), 0)[0] > 0.5 * before


def test_lm_base_as_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randrange(1, 40)), "en", "s", 1) for k in range(60)] + odd_rows()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    df = frame(spark, rows).withColumn("row", F.lit(1))
    training = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm.score(df, training).collect()
    words = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (
            (-1 if d is None else d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
            round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)
        ) for d,
        t, *_ in rows
    )
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(df.where("false"), training).collect() == []
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(df, F.lit(False)).collect())


def test_lm_is_the_same_from_any_layout(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)  # several shards and rounds
    df = frame(spark, [(k, prose(rng, rng.randrange(20, 120)), "en", "s", 1) for k in range(120)])
    runs = [{r.doc_id: r.score for r in lm.score(df.repartition(parts, "doc_id"), F.col("doc_id") % 7 != 2).collect()} for parts in (1, 16)]
    assert runs[0].keys() == runs[1].keys() and all(math.isclose(runs[0][d], runs[1][d], rel_tol=1e-5) for d in runs[0])


def test_gru_gradients_are_finite_differences():
    """A step of gradient descent, told from Adagrad's by its sums of squares, against the loss's differences. State goes in from before the window
    and is cut where a document starts."""
    rng = np.random.default_rng(3)
    steps, lanes = 4, 3
    model = gru.Model(*[(rng.standard_normal(shape) * 0.3).astype(np.float32) for shape in gru.Model.SHAPES])
    ids, target = rng.integers(0, gru.VOCABULARY, (2, steps, lanes))
    keep, h = np.ones((steps, lanes), np.float32), rng.standard_normal((lanes, gru.HIDDEN)).astype(np.float32) * 0.5
    keep[2, 1] = 0

    def loss(m):
        wide = gru.Model(*[getattr(m, n).astype(np.float64) for n in gru.Model.NAMES])
        out, _ = wide.window(ids, keep.astype(float), h.astype(float))
        return -wide.log_probability(out.astype(float), target).sum() / lanes

    trained = gru.Trainer(gru.Model.of(model.flat()))
    trained.train(ids, target, keep, h)
    for name in gru.Model.NAMES:
        grad = np.sqrt(np.maximum(trained.seen[name].astype(float) - 1e-3, 0))
        places = np.argwhere(grad > 0.02)
        for at in map(tuple, places[rng.permutation(len(places))[:8]]):
            moved = [gru.Model.of(model.flat()) for _ in range(2)]
            for m, d in zip(moved, (1e-2, -1e-2), strict=True):
                getattr(m, name)[at] += np.float32(d)
            want = (loss(moved[0]) - loss(moved[1])) / (float(getattr(moved[0], name)[at]) - float(getattr(moved[1], name)[at]))
            step = float(getattr(trained.model, name)[at]) - float(getattr(model, name)[at])
            if name != "w" and name != "wb" or (target // gru.MEMBERS == at[0]).any():
                assert math.isclose(abs(want), grad[at], rel_tol=0.05, abs_tol=0.005), (name, at, want, grad[at])
                assert step * want < 0


# url filter


def test_urls(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q"), (2, "http://example.org/en/12"), (3, "http://x.org"), (4, "http://b.com/fr/a"), (5, "http://b.com/de/"),
        (6, "http://b.net/#f"), (7, None), (8, "no scheme"), (9, "http://example.org/en/2"), (9, "http://example.org/en/2"), (10, "a://b.co.uk/://c")
    ]
    labels = spark.createDataFrame([(6, 1), (6, 0), (None, 1), (3, None)], "page_id bigint, good int")
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("z")), labels, URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and by[2][2:] == ("example.org/en/1", "block")
    assert by[3] == ("x.org", "", None, by[3][3]) and by[4][2:] == ("com/fr/", "allow") and by[5][2:] == ("com/de/", "block")
    assert by[6][:3] == ("b.net", "/", None) and by[7][:3] == ("", "", None) and by[8][:3] == ("", "", None) and by[9][2:] == ("org/", "allow")
    assert by[10][:2] == ("b.co.uk", "/://c")
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string"), labels, URL_RULES).collect() == []


def test_domains(spark):
    hosts = {
        "a.b.co.kr": ("b.co.kr", "co.kr"), "1.2.3.4": ("1.2.3.4", "ip"), "x.example.com": ("example.com", "com"), "co.uk": ("co.uk", "co.uk"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "a.com.au": ("a.com.au", "com.au"), "shop.de": ("shop.de", "de"),
        "1.2.3.4:8080": ("1.2.3.4", "ip"), "a.co.uk:443": ("a.co.uk", "co.uk"), "x.a.com.": ("a.com", "com"), "me:pw@www.shop.de:80": ("shop.de", "de"), "[::1]:80": ("[::1]", "ip")
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urlfilter.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_reputation_shrinks(spark):
    pages = [(k, "good.net") for k in range(200)] + [(200 + k, "bad.net") for k in range(200)] + [(900, "new.good.net"), (901, "new.bad.net")]
    df = spark.createDataFrame([(k, f"http://{h}/") for k, h in pages], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(k, int(k < 200)) for k in range(400)], "page_id bigint, good int")
    bound = {r.host: r.bound for r in urlfilter.judge(df, outcomes, ()).collect()}
    assert bound["good.net"] > bound["new.good.net"] > bound["new.bad.net"] and bound["good.net"] > 0.9 > 0.1 > bound["bad.net"]


def plain_bounds(pages, good, z=1.645):
    """host -> bound, level by level."""
    def worth(level):
        beyond = sum((g - n * p) ** 2 - n * p * (1 - p) for n, g, p in level)
        room = sum(n * p * (1 - p) * (n - 1) for n, _, p in level)
        return 20 if not room else min(max(room / beyond - 1, 1), 1000) if beyond > 0 else 1000

    sums = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for page, (host, domain, suffix) in pages:
        for (n, g), key in zip(sums, (suffix, (domain, suffix), (host, domain, suffix)), strict=True):
            n[key] += page in good
            g[key] += good.get(page, 0)
    prior, up = lambda key: (sum(sums[0][1].values()) + 0.5) / (sum(sums[0][0].values()) + 1), {}
    for k, (n, g) in enumerate(sums):
        p = {key: prior(key) for key in n}
        w = worth([(n[key], g[key], p[key]) for key in n])
        up = {key: (g[key] + p[key] * w, n[key] - g[key] + (1 - p[key]) * w) for key in n}
        post = {key: a / (a + b) for key, (a, b) in up.items()}
        prior = (lambda key, post=post: post[key[1]]) if k == 0 else (lambda key, post=post: post[key[1:]])
    return {h: 1 / (1 + math.exp(z * math.sqrt(1 / a + 1 / b) - math.log(a / b))) for (h, _, _), (a, b) in up.items()}


def test_reputation_as_by_hand(spark):
    rng = random.Random(8)
    share = {f"h{k}.d{k % 9}.{('com', 'net', 'org')[k % 3]}": rng.betavariate(2 + k % 3 * 3, 2) for k in range(40)}
    pages = [(k, rng.choice(list(share))) for k in range(3000)]
    good = {k: int(rng.random() < share[h]) for k, h in pages if rng.random() < 0.7}
    df = spark.createDataFrame([(k, f"http://{h}:80/") for k, h in pages], "page_id bigint, url string")
    outcomes = spark.createDataFrame(list(good.items()), "page_id bigint, good int")
    got = {r.host: r.bound for r in urlfilter.judge(df, outcomes, ()).collect()}
    want = plain_bounds([(k, (f"{h}:80", ".".join(h.split(".")[-2:]), h.split(".")[-1])) for k, h in pages], good)
    assert got.keys() == want.keys() and all(math.isclose(got[h], want[h], abs_tol=1e-8) for h in want)


def test_strength_of_a_prior(spark):
    """Moments find the strength that the counts were drawn with."""
    rng = random.Random(9)
    for s in (4.0, 60.0):
        rows = []
        for _ in range(3000):
            q, n = rng.betavariate(0.7 * s, 0.3 * s), rng.randrange(2, 40)
            rows.append((n, sum(rng.random() < q for _ in range(n)), 0.7))
        assert math.isclose(urlfilter.strength(spark.createDataFrame(rows, "n bigint, g bigint, p double")), s, rel_tol=0.2)
    one = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "n bigint, g bigint, p double")
    assert urlfilter.strength(one) == 20 == urlfilter.strength(one.limit(0))
    assert urlfilter.strength(spark.createDataFrame([(10, 5, 0.5)] * 9, "n bigint, g bigint, p double")) == 1000


def test_bound_is_near_the_quantile():
    """The approximation holds the 5 % quantile of the beta to 0.03 for counts of a few pages and more."""
    rng = np.random.default_rng(10)
    for a, b in ((3, 2), (8, 3), (20, 4), (50, 50), (200, 10)):
        true = np.quantile(rng.beta(a, b, 400000), 0.05)
        assert abs(1 / (1 + math.exp(1.645 * math.sqrt(1 / a + 1 / b) - math.log(a / b))) - true) < 0.03


# mixing


def test_mixing_rates_and_counts(spark):
    rows = [(k, f"t{k}", "en", "big" if k < 3000 else "small", 1) for k in range(4000)]
    got = mixing.mix_sources(frame(spark, rows), {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["big"] - 1000) < 130 and abs(n["small"] - 3000) < 220
    again = mixing.mix_sources(frame(spark, rows[::-1]), {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in again} == n


def test_poisson_inverse(spark):
    us = [0.001, 0.2, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(m, u) for m in (0.3, 1.0, 7.5, 16.0) for u in us], "m double, u double").withColumn("t", mixing.poisson_table(F.col("m")))
    for r in df.select("m", "u", F.size(F.filter("t", lambda p: p < F.col("u"))).alias("k")).collect():
        k, p = 0, math.exp(-r.m)
        while p < r.u:
            k += 1
            p += math.exp(-r.m) * r.m**k / math.factorial(k)
        assert r.k == k


def test_mixing_edges(spark):
    got = mixing.mix_sources(frame(spark, odd_rows()).withColumn("mean", F.lit(1)).withColumn("_copy", F.lit(9)), total=200.0).collect()
    assert 120 < len(got) < 300 and {r.source for r in got} == {None, "s"}
    copies = Counter((r.doc_id, r.text, r._copy) for r in got)
    assert max(v for (d, *_), v in copies.items() if d == 0) == 1
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert mixing.mix_sources(frame(spark, odd_rows()), {}).collect() == []


# components


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(20)] + [(200, 200 + k) for k in range(1, 30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).collect() == []


def test_gru_size_and_every_token_trained():
    assert (gru.CLASSES, gru.MEMBERS, gru.HIDDEN) == (48, 48, 16)

    class Seen:
        def __init__(self):
            self.targets = []

        def train(self, ids, target, keep, h):
            self.targets += [(int(a), int(b), float(k)) for a, b, k in zip(ids.ravel(), target.ravel(), keep.ravel(), strict=True)]
            return h

    for n in (1, 7, 100, 1003):
        trainer, starts = Seen(), np.zeros(n, bool)
        starts[[0, n // 2]] = True
        gru.train_on(trainer, np.arange(1, n + 1), starts, 0, lanes=16, steps=10)
        assert sorted(trainer.targets, key=lambda r: r[1]) == [(0 if starts[k] else k, k + 1, 0.0 if starts[k] else 1.0) for k in range(n)]


def test_mixing_is_poisson_at_a_large_mean(spark):
    rows = [(k, "t", "en", "rare" if k < 400 else "big", 1) for k in range(800)]
    got = mixing.mix_sources(frame(spark, rows), {"rare": 1.0}, total=80000.0).groupBy("doc_id").count().collect()
    n = np.array([r["count"] for r in got])
    assert len(n) == 400 and abs(n.mean() - 200) < 4 and 150 < n.var() < 260
