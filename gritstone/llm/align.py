"""Alignment of two tokenizers' tokens of a text by a dangling-suffix transducer.

The transducer reads the tokens of both sides, always the next one of the side that is behind. Its state is the side that leads and the bytes by which
it leads; where these are none, both sides have just ended a token, and a group closes. Steps are remembered by state and token.
Each step but a group's first reads a token whose bytes overlap those of the other side's last one: a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bpe, Remembered, _Index, joined
from .pieces import SPACE, Pieces
from .shared import drop, save, slices

#: Pairs of ids whose counts go to tasks in one step (17 bytes each); with more of them there are more steps.
TRAVELS = 1 << 20
#: Parts and transitions that a task remembers, and distinct pairs that it counts before it hands them on.
PARTS, STEPS, COUNTED = 1_000_000, 1 << 20, 1 << 20
#: Kept by worker processes from task to task, by models.
_ALIGNERS: dict[tuple[int, int], Aligner] = {}


class Transducer:
    """a and b: the bytes of each id on either side."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = (a, b)
        self.clear()

    def clear(self) -> None:
        #: State 0: no bytes dangle. Of the others: which side is behind, and the bytes it has to catch up with.
        self.states: dict[tuple[int, bytes], int] = {}
        self.behind, self.rest = [0], [b""]
        self.steps: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that is behind (of neither: the first side's); -1 where its bytes aren't those of the other."""
        side, rest = self.behind[state], self.rest[state]
        own = self.tokens[side][token]
        if not state:
            lead, dangling = 0, own
        elif len(own) <= len(rest):
            lead, dangling = 1 - side, rest[len(own) :]
            if rest[: len(own)] != own:
                return -1
        else:
            lead, dangling = side, own[len(rest) :]
            if own[: len(rest)] != rest:
                return -1
        if not dangling:
            return 0
        found = self.states.setdefault((lead, dangling), len(self.behind))
        if found == len(self.behind):
            self.behind.append(1 - lead)
            self.rest.append(dangling)
        return found

    def align(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of many texts, a[a_ends[k]:a_ends[k + 1]] and b likewise: for each step that reads a token, its text, its side, its place (in a or b),
        whether it is a link and whether it closes a group, text by text in order; and which texts differ between the sides (they have no steps).

        All texts go on a step at a time; of equal (state, token) pairs among them one is looked up.
        """
        n = len(a_ends) - 1
        at, end = np.stack([a_ends[:-1], b_ends[:-1]]), np.stack([a_ends[1:], b_ends[1:]])
        ids, state, live, wrong = (a, b), np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        while len(live):
            done = (state[live] == 0) & (at[0, live] == end[0, live]) & (at[1, live] == end[1, live])
            live = live[~done]
            states, where = np.unique(state[live], return_inverse=True)
            side = np.array([self.behind[s] for s in states.tolist()], np.int64)[where] if len(live) else live
            short = at[side, live] >= end[side, live]
            wrong[live[short]] = True
            live, side = live[~short], side[~short]
            if not len(live):
                break
            place = at[side, live]
            token = np.empty(len(live), np.int64)
            for k in (0, 1):
                token[side == k] = ids[k][place[side == k]]
            keys, inverse = np.unique(state[live] << 20 | token, return_inverse=True)
            after = np.array([self._next(key) for key in keys.tolist()], np.int64)[inverse]
            at[side, live] += 1
            wrong[live[after < 0]] = True
            for column, x in zip(out, (live, side, place, state[live] > 0, after == 0), strict=True):
                column.append(x)
            state[live] = after
            live = live[after >= 0]
        text, side, place, link, close = map(np.concatenate, out)
        order = np.argsort(text, kind="stable")
        order = order[~wrong[text[order]]]
        return text[order], side[order], place[order], link[order].astype(bool), close[order].astype(bool), wrong

    def _next(self, key: int) -> int:
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self.step(key >> 20, key & 0xFFFFF)
        return found


class Aligner:
    """Aligns texts part by part: a part is a run of blanks and the word after it, which no token of either side crosses. A part met before is not
    aligned again."""

    def __init__(self, a: Bpe, b: Pieces):
        self.a, self.b = a, b
        self.width = len(b.pieces)
        self.transducer = Transducer([a.token_bytes(n) for n in a.names], b.raw)
        self.first = a.encoder()
        self.names = [str(k) for k in range(max(len(a.names), len(b.pieces)))]
        #: Blanks that a piece holds: a text with one is aligned as a whole.
        self.inside = [c for c in b.known if c.isspace()]
        self.clear()

    def clear(self) -> None:
        self.parts = Remembered(self._make, np.int64)
        #: For each part: tokens on either side, groups, whether the sides differ; and its groups.
        self.facts, self.groups = np.zeros((0, 4), np.int32), []

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = " " + text
        return [text] if any(c in text for c in self.inside) else self.a.parts(text)

    def _second(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all parts, end to end, and len + 1 bounds."""
        rows = [self.b.stretch.findall(p.replace(" ", SPACE)) for p in parts]
        own = _Index()
        which = np.fromiter(map(own.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        made, size = joined(self.b.encode_stretches(list(own))) if own else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        begin, size = (np.cumsum(size) - size)[which], size[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = made[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])])]

    def _make(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The links of each part, as a * width + b, end to end, and how many each has."""
        if len(self.transducer.steps) > STEPS:
            self.transducer.clear()
        one, sizes = self.first.make(parts)
        two, two_ends = self._second(parts)
        one_ends = np.concatenate([[0], np.cumsum(sizes)])
        text, side, place, link, close, wrong = self.transducer.align(one.astype(np.int64), one_ends, two.astype(np.int64), two_ends)
        n = len(parts)
        count = lambda on: np.bincount(text[on], minlength=n)
        self.facts = np.concatenate([self.facts, np.stack([count(side == 0), count(side == 1), count(close), wrong], 1).astype(np.int32)])
        # At a link the last tokens read on either side overlap.
        last = [np.maximum.accumulate(np.where(side == k, np.arange(len(side)), 0)) for k in (0, 1)]
        token = np.zeros(len(side), np.int64)
        for k, ids in ((0, one), (1, two)):
            token[side == k] = ids[place[side == k]]
        pairs = token[last[0][link]] * self.width + token[last[1][link]]
        self.groups += self._texts(text, side, token, close, n)
        return pairs, count(link)

    def _texts(self, text: np.ndarray, side: np.ndarray, token: np.ndarray, close: np.ndarray, n: int) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text: in a group the first side's tokens come before the second's."""
        out = [""] * n
        if not len(text):
            return out
        group = np.cumsum(close) - close
        order = np.lexsort((side, group))
        text, side, token, group = text[order], side[order], token[order], group[order]
        same = np.concatenate([group[1:] == group[:-1], [False]])
        turn, ends = same & (side != np.append(side[1:], 0)), text != np.append(text[1:], -1)
        mark = np.where(ends, 3, np.where(~same, 2, turn)).tolist()
        names, marks = self.names, (",", "|", ";", "\n")
        lines = "".join([names[t] + marks[m] for t, m in zip(token.tolist(), mark, strict=True)]).split("\n")
        for k, line in zip(np.unique(text).tolist(), lines, strict=False):
            out[k] = line
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts that can be aligned, end to end, and len + 1 bounds."""
        if len(self.parts.index) > PARTS:
            self.clear()
        rows = [self.cut(t) for t in texts]
        which = self.parts.numbers(rows)
        size = np.array([len(r) for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), size)
        wrong = np.zeros(len(rows), bool)
        wrong[row[self.facts[which, 3] > 0]] = True
        return which[~wrong[row]], np.concatenate([[0], np.cumsum(np.where(wrong, 0, size))])


ADDED = {"_n_a": "bigint", "_n_b": "bigint", "_n_groups": "bigint", "_n_links": "bigint", "_n_best": "bigint", "_count_sum": "bigint"}


def _aligned(docs: DataFrame, a: Bpe, b: Pieces, column: str, groups: str, keep: list[str]) -> DataFrame:
    """keep, _n_a, _n_b, _n_groups, _n_links, the groups, and _links as of pack()."""
    numbers = [F.lit(None).cast("bigint").alias(c) for c in list(ADDED)[:4]]
    schema = docs.select(*keep, *numbers, F.lit(None).cast("string").alias(groups), F.lit(None).cast("binary").alias("_links")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _ALIGNERS.get((a.key, b.key)) or Aligner(a, b)
        _ALIGNERS[a.key, b.key] = aligner
        for held in slices(batches, column):
            which, bounds = aligner.read(held.column(column).to_pylist())
            total = np.zeros((len(which) + 1, 3), np.int64)
            np.cumsum(aligner.facts[which, :3], axis=0, out=total[1:])
            n_a, n_b, n_groups = (total[bounds[1:]] - total[bounds[:-1]]).T
            links, ends = aligner.parts.arrays(which)
            ends = ends[bounds]
            texts, packed, flat = [], [], which.tolist()
            for i, j, k, m in zip(bounds, bounds[1:], ends, ends[1:], strict=False):
                text = ";".join([aligner.groups[p] for p in flat[i:j]])
                texts.append(text if groups == "_groups" or not text else hashlib.sha256(text.encode()).hexdigest())
                packed.append(pack(links[k:m]))
            columns = [n_a, n_b, n_groups, n_a + n_b - n_groups]
            yield pa.RecordBatch.from_arrays(
                [*[held.column(c) for c in keep], *[pa.array(c) for c in columns], pa.array(texts, pa.string()), pa.array(packed, pa.binary())], names
            )

    return docs.mapInArrow(run, schema)


def pack(links: np.ndarray) -> bytes:
    """The distinct links, ascending, as 64-bit numbers, and then how often each is there as 16-bit ones; one that is there more often comes again."""
    pairs, times = np.unique(links, return_counts=True)
    if len(times) and times.max() > 0xFFFF:
        again = -(-times // 0xFFFF)
        place = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
        pairs, times = np.repeat(pairs, again), np.minimum(np.repeat(times, again) - place * 0xFFFF, 0xFFFF)
    return pairs.astype("<i8").tobytes() + times.astype("<u2").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u2", n, 8 * n)


def _counted(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (the rows that hold it linked) and best (whether no pair of its first id is in more). Pairs are counted within tasks first; there are no
    more of them than the two vocabularies have overlapping pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for held in slices(batches, "_links", 1 << 23):
            own = np.concatenate([pairs[:0], *[np.unique(unpack(raw)[0]) for raw in held.column("_links").to_pylist()]])
            own, times = np.unique(own, return_counts=True)
            pairs, of = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, times]), len(pairs)).astype(np.int64)
            if len(pairs) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    made = rows.select("_links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / width))  # at most b's vocabulary
    return made.withColumn("best", F.col("n") == F.max("n").over(of_a))


def align(docs: DataFrame, a: Bpe, b: Pieces, column: str = "text", groups: str = "_groups", keep_text: bool = True) -> DataFrame:
    """The columns of docs and, of a blank and the text in that column, as a encodes it and as b does (which adds the blank itself): _n_a and _n_b
    (tokens), _groups (their ids in groups that end where tokens of both end, as `a1,a2|b1;a3|b2,b3`), _n_groups, _n_links (pairs of tokens whose
    bytes overlap), _n_best (those whose pair of ids no other pair of a's id exceeds in the number of rows of docs that hold it) and _count_sum (these
    numbers, over all links).

    groups: `_groups`, or `_groups_sha256` for a column with the SHA-256 of each such text in its place, which is shorter to write. Without keep_text
    the column of texts is left out. A null or empty text, and one that either side's tokens don't give back byte by byte (one with U+2581, which b
    reads as a blank), has zeros and an empty _groups (or digest), and adds to no count. Repeated rows are rows of their own. Columns of docs with
    these names are replaced, others pass through.

    Texts are read and encoded once: what is known of each, and its links, are a table, from which the links are counted and then summed up.
    """
    docs = docs.select(*[c for c in docs.columns if c not in (*ADDED, groups, "_links")])
    keep = [c for c in docs.columns if keep_text or c != column]
    rows = save(_aligned(docs, a, b, column, groups, keep), "aligned", "zstd")
    counts = save(_counted(rows, len(b.pieces)), "link-counts")
    parts = max(1, -(-counts.count() // TRAVELS))
    rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("_n_best", "_count_sum")})
    for k in range(parts):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k).orderBy("pair").toArrow()  # about TRAVELS rows
        rows = _summed(rows, [part.column(c).to_numpy() for c in ("pair", "n", "best")])
    drop(counts)
    return rows.select(*keep, *ADDED, groups)


def _summed(rows: DataFrame, table: list[np.ndarray]) -> DataFrame:
    """rows with what this part of the counts adds to _n_best and _count_sum."""
    pair, n, best = table
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slices(batches, "_links", 1 << 23):
            each = [unpack(raw) for raw in held.column("_links").to_pylist()]
            links, times = (np.concatenate(x).astype(np.int64) for x in zip(*each, strict=True))
            at = np.minimum(np.searchsorted(pair, links), max(0, len(pair) - 1))
            there = pair[at] == links if len(pair) else np.zeros(len(links), bool)
            value = np.zeros((len(links) + 1, 2), np.int64)
            if len(pair):
                value[1:, 0], value[1:, 1] = best[at] * times * there, n[at] * times * there
            value, ends = np.cumsum(value, axis=0), np.concatenate([[0], np.cumsum([len(p) for p, _ in each])])
            sums = value[ends[1:]] - value[ends[:-1]]
            new = {"_n_best": sums[:, 0], "_count_sum": sums[:, 1]}
            yield pa.RecordBatch.from_arrays([pa.array(held.column(c).to_numpy() + new[c]) if c in new else held.column(c) for c in names], names)

    return rows.mapInArrow(run, rows.schema)
