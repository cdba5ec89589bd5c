"""Ranked lexical search over inverted treaps.

The postings of a term are a treap: by doc_id in search order, by impact (the term's part of a document's score) in heap order, so the root of a
subtree is the most that the term can add within its range of documents. A query goes down the treaps of its terms together: it takes the posting of
the largest impact among the roots, scores that document, and splits every treap there into a range before and one after. A range whose roots add up
to less than the k-th best score so far is left alone as a whole.

Documents are dealt into blocks of about as many postings; a block's treaps are made and searched in one task, and each block's best k meet at the
end. The first block is searched before the others, and gives them a score to begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, hash_words, mix, save, slices

#: Bytes that end a term: terms are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
ENDS = np.ones(256, bool)
ENDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Postings of a block, and terms of the queries that are looked for in one pass over the documents; with more of them there are more passes.
BLOCK, TERMS = 1 << 20, 1 << 20
#: Ranges that a query splits at a time, those that promise most first.
RANGES = 256
#: Weights of a term and a document, in thousandths, tenths of percents and so on, as the score's definition has them. Fixed values.
LENGTH_SHARE, SATURATION = 90, 8


def terms_of(texts: DataFrame, key: str) -> DataFrame:
    """key and h, the hash of each of its terms, once each; texts without terms have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slices(batches):
            hashes, bounds = hash_words(held.column("text"), ENDS)
            row = np.repeat(np.arange(len(held)), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([held.column(key).take(pa.array(row)), pa.array(hashes.view(np.int64))], [key, "h"])

    return texts.select(key, "text").mapInArrow(run, f"{key} bigint, h bigint").distinct()


def forward(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n (all terms with repeats), and of the terms in `terms` (sorted hashes) that the document holds: their places there and how often it
    holds each. Documents without any term have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slices(batches):
            hashes, bounds = hash_words(held.column("text"), ENDS)
            n = np.diff(bounds)
            at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
            there = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
            row = np.repeat(np.arange(len(held)), n)[there]
            key, tf = np.unique(row * max(1, len(terms)) + at[there], return_counts=True)
            row, term = key // max(1, len(terms)), key % max(1, len(terms))
            ends = pa.array(np.searchsorted(row, np.arange(len(held) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            made = pa.RecordBatch.from_arrays([held.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
            yield made.filter(pa.array(n > 0))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Treaps:
    """The treaps of the postings (term, doc, impact): docs are places in the block's order of doc_id."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        n = len(term)
        # Equal impacts (as copies have) are ordered by a hash, or a treap of them would be a list.
        rank = np.empty(n, np.int64)
        rank[np.lexsort((mix(self.doc.astype(np.uint64) + np.uint64(1)), -self.impact))] = np.arange(n)
        self.terms, starts, place = np.unique(term, return_index=True, return_inverse=True)
        self.keys, self.size = (place << 32) + self.doc, int(self.doc.max()) + 1 if n else 0
        self.roots = np.full(len(self.terms), -1)
        left, right, ranks = [-1] * n, [-1] * n, rank.tolist()
        for t, (i, j) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)):
            spine: list[int] = []  # the path from the root to the last posting
            for p in range(i, j):
                below = -1
                while spine and ranks[spine[-1]] > ranks[p]:
                    below = spine.pop()
                left[p] = below
                if spine:
                    right[spine[-1]] = p
                spine.append(p)
            self.roots[t] = spine[0]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def root(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the subtrees at nodes (a row a range, a column a term; -1: empty) the topmost postings of documents lo to hi - 1 of each row: those of
        the largest impact there."""
        out = nodes.ravel().copy()
        wide = nodes.shape[1]
        lo, hi = np.repeat(lo, wide), np.repeat(hi, wide)
        live = np.flatnonzero(out >= 0)
        while len(live):
            node = out[live]
            doc = self.doc[node]
            low, high = doc < lo[live], doc >= hi[live]
            step = np.where(low, self.right[node], np.where(high, self.left[node], node))
            out[live] = step
            live = live[(low | high) & (step >= 0)]
        return out.reshape(nodes.shape)

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The sums of impacts of these documents over terms (places in self.terms)."""
        key = (terms[None, :] << 32) + docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.impact[at], 0).sum(1)

    def best(self, terms: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k documents with the highest sums of impacts over the terms, of `least` or more, by score and document; their scores; and how many were
        scored."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        own = at[self.terms[at] == terms] if len(self.terms) else at[:0]
        docs, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        nodes, lo, hi = self.roots[own][None, :], np.zeros(1, np.int64), np.array([self.size])
        bound = np.array([self.impact[nodes[0]].sum()])
        while len(nodes):
            kth, last = (scores[-1], docs[-1]) if len(docs) == k else (least, self.size)
            live = (bound > kth) | ((bound == kth) & (lo < last))
            nodes, lo, hi, bound = nodes[live], lo[live], hi[live], bound[live]
            if not len(nodes):
                break
            rest = np.ones(len(bound), bool)
            rest[np.argpartition(-bound, RANGES)[:RANGES] if len(bound) > RANGES else slice(None)] = False
            now, begin, end = nodes[~rest], lo[~rest], hi[~rest]
            pivot = self.doc[now[np.arange(len(now)), np.where(now >= 0, self.impact[now], -1).argmax(1)]]
            docs, scores = np.concatenate([docs, pivot]), np.concatenate([scores, self.scores(own, pivot)])
            order = np.lexsort((docs, -scores))[:k]
            order = order[scores[order] >= least]
            docs, scores, scored = docs[order], scores[order], scored + len(pivot)
            halves = [self.root(now, begin, pivot), self.root(now, pivot + 1, end)]
            nodes = np.concatenate([nodes[rest], *halves])
            lo, hi = np.concatenate([lo[rest], begin, pivot + 1]), np.concatenate([hi[rest], pivot, end])
            bound = np.concatenate([bound[rest], *[np.where(x >= 0, self.impact[x], 0).sum(1) for x in halves]])
        return docs, scores, scored


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a document of n terms: integers, rounded down where the definition does."""
    norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * norm))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents (all, if fewer) with the highest scores above 0 for each item, equal scores by
    ascending doc_id.

    docs: doc_id, text; items: item_id, text. A text's terms are its longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased; a null text has none. The weight w of a term is floor(1000 * ln((2N + 2) / (2df + 1))) with N the documents that have a term and df
    those that hold this one; a document of n terms, of L in all, has m = 10 + (90 n N) div L; it scores the sum, over the item's terms, once
    each, of w * ((10**9 tf) div (1000 tf + 8 m)).

    Rows of docs with a null doc_id take no part; rows with the same doc_id are documents of their own. Rows of items with the same item_id (also null)
    are one item. Items without terms, or whose terms no document holds, have no rows. Other columns aren't looked at. No documents give no rows.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    held = save(terms_of(items, "item_id"), "item-terms")
    passes, out = max(1, -(-held.count() // TERMS)), None
    for p in range(passes):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()  # about TERMS rows
        found = _searched(docs, part, k)
        out = found if out is None else out.unionByName(found)
    drop(held)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


FOUND = "item_id bigint, doc_id bigint, score bigint"


def _searched(docs: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """Each block's best k for each item of queries (item_id, h)."""
    spark = docs.sparkSession
    terms = np.unique(queries.column("h").to_numpy().view(np.uint64))
    names, number = np.unique(queries.column("item_id").fill_null(-(1 << 63)).to_numpy(), return_inverse=True)
    term = np.searchsorted(terms, queries.column("h").to_numpy().view(np.uint64))
    order = np.lexsort((term, number))
    ends = np.searchsorted(number[order], np.arange(len(names) + 1))
    wanted = [term[order][i:j] for i, j in zip(ends, ends[1:], strict=False)]
    null = names == -(1 << 63)

    # A row's number is written with it: both searches must deal it to the same block, however Spark cuts the table for them.
    postings = save(forward(docs, terms).withColumn("number", F.xxhash64(F.monotonically_increasing_id())), "postings")
    total = postings.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("p")).collect()[0]
    if not total["p"]:
        return spark.createDataFrame([], FOUND)
    documents, length = total["N"], total["L"]
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2 * F.col("df") + 1))).alias("w")
    counts = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).select("t", weight).toArrow()  # at most a row a term
    weights = np.zeros(len(terms), np.int64)
    weights[counts.column("t").to_numpy()] = counts.column("w").to_numpy()

    blocks = max(1, -(-total["p"] // BLOCK))
    dealt = postings.where(F.size("terms") > 0).withColumn("block", F.pmod("number", F.lit(blocks)).cast("int")).drop("number")

    def searcher(least: np.ndarray):
        def run(block: pa.Table) -> pa.Table:
            block = block.sort_by("doc_id").combine_chunks()
            n, ids = block.column("n").to_numpy(), block.column("doc_id").to_numpy()
            lists = [block.column(c).combine_chunks() for c in ("terms", "tfs")]
            doc = np.repeat(np.arange(len(ids)), lists[0].value_lengths().to_numpy())
            own, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            treaps = Treaps(own, doc, impacts(weights[own], tf, n[doc], documents, length))
            item, found, score = [], [], []
            for q, want in enumerate(wanted):
                docs, scores, _ = treaps.best(want, k, int(least[q]))
                item.append(np.full(len(docs), q))
                found.append(ids[docs])
                score.append(scores)
            item = np.concatenate(item)
            return pa.table([pa.array(names[item], mask=null[item]), pa.array(np.concatenate(found)), pa.array(np.concatenate(score))], names=["item_id", "doc_id", "score"])

        return run

    least = np.ones(len(names), np.int64)
    first = save(dealt.where("block = 0").groupBy("block").applyInArrow(searcher(least), FOUND), "first-block")
    if blocks == 1:
        return first
    kth = first.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).where(F.col("c") == k).toArrow()  # a row an item
    least[np.searchsorted(names, kth.column("item_id").fill_null(-(1 << 63)).to_numpy())] = kth.column("s").to_numpy()
    others = dealt.where("block > 0").groupBy("block").applyInArrow(searcher(least), FOUND)
    return first.unionByName(others)
