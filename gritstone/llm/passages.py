"""Substring dedup by compact windows: near-duplicate passages of documents, found by min-hash over Cartesian trees.

A text is its sequence of word shingles. Under a hash function, all stretches of it whose least-hashed shingle is the one at c form a compact window
(l, c, r): they
start in l..c and end in c..r, where l..r is the subtree of c in the Cartesian tree of the hashes. Windows that hold a stretch of the least
length are kept. Two stretches of similarity s share the least hash, a window's key, under each function with probability s.

Equal texts are one node. Windows of a key that few nodes have are all held against each other. A key of more nodes is hot: its windows make no pairs;
each stretch of the least length that one of them holds goes by an exact way instead, a prefix join of the stretches' sets of shingles. What happens to
a window follows from keys and nodes alone, never from how rows lie in tasks.

The exact way: two sets of similarity s share at least s of either, so one of the rarest shingles of both, as many as may be missing and one more. Of a
shingle that few nodes have, all nodes are held against each other. Stretches with others among their rarest ones are classes: those with the same
shared shingles, whatever else they hold, and of the same size, have the same similarity to each other and to any other stretch. A class's members are
held against its first. Classes that aren't linked yet are held against each other, by bits of their shingles and then by whole sets; of two components
one similar pair of classes stays. A longer passage that holds no similar stretch of the least length is not looked for in this way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import SLICE_BYTES, SPACE, drop, hash_words, id_bits, in_bits, mix, save, shingles, signed, slices, text_bytes, with_slot

#: Hash functions, and how many of them must agree on a pair of stretches: at similarity 0.8 a pair is missed with probability 0.0016.
FUNCTIONS, AGREE = 6, 2
#: A key is hot that about more nodes have (counted in 64 bits, so that copies in other tasks don't count again).
MEET = 8
#: Of the shingles that more nodes have, those of which so many of the 64 bits are set (about 90 nodes) come last in the order of the exact way.
MANY = 48
#: The most stretches of a run; a longer one goes on as the next, at the same places of a text in any layout.
RUN = 1 << 13
#: Classes of stretches whose contents a task remembers having written.
TOLD = 1 << 18
#: Windows of a node with the same key that are kept apart; more, as in a text of one repeated line, are one window that spans them.
APART = 4
#: Windows of a pair of documents up to which all are held against all at once; above it, one after another.
AT_ONCE = 64
#: Runs of a pair of texts up to which all are held against all at once.
FEW = 512
#: Windows whose keys a task counts at a time.
COUNTED = 1 << 20
#: The largest filter of keys: 32 MB. Where it fills up, more rows go through to the joins; results stay.
MOST_BITS = 28
#: The low bits of a key that say where it is in the largest filter's words. Keys are put in order by them, so a group of keys is one place of a filter.
PLACE = MOST_BITS - 6
#: In place of a function: a stretch whose shingles are all equal, which needs no other to agree. A window that spans several is marked by SPANS.
WHOLE, SPANS = 30, 64
_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
WINDOW = "key bigint, node bigint, lc bigint, rf bigint, part binary"
#: The columns of a stretch that hold the bits of a class, which has no place.
BITS = ("node", "lc", "rf", "up")
STRETCH = "kind int, key bigint, node bigint, lc bigint, rf bigint, up bigint, rep bigint, solid boolean, tokens array<bigint>, size int, held int"


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] for each i, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def _jumped(to: np.ndarray, passed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each place the first one on its way (to[k], then where that one's own way has got to, and so on) that isn't passed by; len(to) is no place,
    and never is."""
    none = len(to)
    live = np.flatnonzero(to < none)
    while len(live):
        live = live[passed(to[live], live)]
        to[live] = to[to[live]]
        live = live[to[live] < none]
    return to


def _roots(hashes: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Places of the texts hashes[bounds[d]:bounds[d + 1]] that have a least hash of some stretch of that length, the others of equal ones too. So their
    hashes are those of the leftmost ones."""
    n, size = len(hashes), np.diff(bounds)
    if n < least or not (size >= least).any():
        return np.zeros(0, np.int64)
    low = _sliding(np.minimum, hashes, least)
    inside = np.zeros(n + 1, np.int64)
    long = size >= least
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - least + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, np.uint64(0))
    pad = np.zeros(least - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, low, pad]), least) == hashes)


def compact_windows(hashes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive, places in hashes) of the nodes, whose subtree has at least so many items, of the Cartesian trees of the texts
    hashes[bounds[d]:bounds[d + 1]]. Of equal hashes the leftmost is the root.

    Such a node has the least hash of some stretch of that length, and what bounds its subtree is another such node: so only these go through the
    loop.
    """
    c = _roots(hashes, bounds, least)
    if not len(c):
        return c, c, c
    doc = np.searchsorted(bounds, c, "right") - 1
    values, at, m = hashes[c], np.arange(len(c)), len(c)
    first, last = np.append(True, doc[1:] != doc[:-1]), np.append(doc[1:] != doc[:-1], True)
    before = _jumped(np.where(first, m, at - 1), lambda p, k: values[p] > values[k])
    after = _jumped(np.where(last, m, at + 1), lambda p, k: values[p] >= values[k])
    places = np.append(c, 0)
    l = np.where(before == m, bounds[doc], places[before] + 1)
    r = np.where(after == m, bounds[doc + 1] - 1, places[after] - 1)
    kept = r - l + 1 >= least
    return l[kept], c[kept], r[kept]


def _spanned(keys: np.ndarray, doc: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """keys, doc, l, c, r, spans: where a text has more than APART windows of a key, one stands for all."""
    order = np.lexsort((keys, doc))
    keys, doc, l, c, r = (x[order] for x in (keys, doc, l, c, r))
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    many = np.repeat(size > APART, size)
    if many.any():
        l, r = np.where(many, np.repeat(np.minimum.reduceat(l, start), size), l), np.where(many, np.repeat(np.maximum.reduceat(r, start), size), r)
    first = np.zeros(len(keys), bool)
    first[start] = True
    stay = first | ~many
    return tuple(x[stay] for x in (keys, doc, l, c, r, many))


def _unpacked(lc: np.ndarray, rf: np.ndarray) -> np.ndarray:
    """l, c0, c1, r in rows."""
    l, c, r = lc >> 32, lc & 0xFFFFFFFF, rf >> 8
    spans = (rf & SPANS) > 0
    return np.stack([l, np.where(spans, l, c), np.where(spans, r, c), r])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words a text has, in its place."""
    for batch in slices(batches):
        raw, bounds = text_bytes(batch.column("text"))
        space = np.concatenate([[True], SPACE[raw], [True]])
        first = space[:-1] & ~space[1:]
        first[bounds] = ~space[bounds + 1]  # no word crosses from a text to the next
        words = np.diff(np.searchsorted(np.flatnonzero(first), bounds)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(words)], ["doc_id", "node", "words"])


def _texts(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """nodes, shingles and bounds of the texts that are long enough; a task looks at a node once."""
    seen: set[int] = set()
    for batch in slices(batches):
        s, bounds = shingles(*hash_words(batch.column("text")), size)
        nodes = batch.column("node").to_numpy()
        own = []
        for d in np.flatnonzero(np.diff(bounds) >= least).tolist():
            if int(nodes[d]) not in seen:
                seen.add(int(nodes[d]))
                own.append(d)
        if own:
            parts = [s[bounds[d] : bounds[d + 1]] for d in own]
            yield nodes[own], np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _rolled(keys: np.ndarray, by: int = PLACE) -> np.ndarray:
    """The low bits of the keys first. What is least of many hashes has low topmost bits; these are even."""
    return keys << np.uint64(64 - by) | keys >> np.uint64(by)


def _counted_keys(texts: DataFrame, size: int, least: int) -> DataFrame:
    """key, hot and many of the keys that more than one node has: those whose least and largest nodes differ. How many nodes a key has is told from 64 bits
    of which each node sets one; that decides `hot` and `many` alone. Windows are counted within tasks first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for nodes, s, bounds in _texts(batches, size, least):
            for seed in _SEEDS:
                h = mix(s ^ seed)
                c = _roots(h, bounds, least)  # a key needs no window
                yield h[c], nodes[np.searchsorted(bounds, c, "right") - 1]

    return _shared(texts, emit, "keys")


def _shared(rows: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], name: str) -> DataFrame:
    """key, hot and many of the keys that more than one node has, of the keys and nodes that emit() makes of rows. Keys travel in groups, many to a row, of
    which a partition has about ten."""
    log_groups = min(PLACE, (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys, nodes in emit(batches):
            held.append((_rolled(keys), nodes))
            n += len(keys)
            if n >= COUNTED:
                yield _packed(held, log_groups)
                held, n = [], 0
        if n:
            yield _packed(held, log_groups)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            groups = batch.column("keys").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0  # the last group may go on in the next batch
            if n >= COUNTED and cut:
                yield _met([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += len(text_bytes(batch.column("ones"))[0]) // 16 + len(text_bytes(batch.column("several"))[0]) // 32
        if held:
            yield _met(held)

    packed = rows.mapInArrow(count, "keys int, ones binary, several binary").repartition("keys").sortWithinPartitions("keys")
    return save(packed.mapInArrow(gather, "key bigint, hot boolean, many boolean"), name)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], log_groups: int) -> pa.RecordBatch:
    """Rows of the groups of (rolled) keys: keys that one node has, with it; and others, with the least and largest node and their bits."""
    counted = _counted(held)
    keys, node = (counted.column(c).to_numpy().view(np.uint64) for c in ("key", "node"))
    one = counted.column("last").is_null().to_numpy(zero_copy_only=False)
    last, bits = (counted.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("last", "bits"))
    group = (keys >> np.uint64(64 - log_groups)).astype(np.int32)
    names = np.unique(group)
    columns = []
    for own, parts in ((one, (keys, node)), (~one, (keys, node, last, bits))):
        data = np.stack([x[own] for x in parts], axis=1)
        ends = np.append(0, np.searchsorted(group[own], names, "right")) * 8 * len(parts)
        columns.append(pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays([pa.array(names), *columns], ["keys", "ones", "several"])


def _met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """key, hot and many of the keys in rows of _packed() that more than one node has."""
    ones, several = (np.concatenate([text_bytes(x.column(c))[0] for x in held]).view(np.uint64).reshape(-1, n) for c, n in (("ones", 2), ("several", 4)))
    keys = np.concatenate([ones[:, 0], several[:, 0]])
    order = np.argsort(keys)
    keys = keys[order]
    same = np.append(False, keys[1:] == keys[:-1])[: len(keys)]
    may = np.flatnonzero(same | np.append(same[1:], False)[: len(keys)] | (order >= len(ones)))
    keys, at = keys[may], order[may]
    rows = np.zeros((len(at), 3), np.int64)  # nodes are signed here as in _counted()
    alone = at < len(ones)
    node = ones[at[alone], 1]
    rows[alone] = np.stack([node, node, np.uint64(1) << (node >> np.uint64(58))], axis=1).view(np.int64)
    rows[~alone] = several[at[~alone] - len(ones), 1:].view(np.int64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if len(start):
        low, high, bits = np.minimum.reduceat(rows[:, 0], start), np.maximum.reduceat(rows[:, 1], start), np.bitwise_or.reduceat(rows[:, 2], start)
    else:
        low = high = bits = np.zeros(0, np.int64)
    met = low != high
    n = np.bitwise_count(bits[met].view(np.uint64))
    return pa.RecordBatch.from_arrays([signed(_rolled(keys[start[met]], 64 - PLACE)), pa.array(n > MEET), pa.array(n > MANY)], ["key", "hot", "many"])


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Of each key its least node and, where it has several, the largest and a bit for each by its topmost six bits (nodes are hashes)."""
    keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    low, high = np.minimum.reduceat(nodes, start), np.maximum.reduceat(nodes, start)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (nodes.view(np.uint64) >> np.uint64(58)), start).view(np.int64)
    one = low == high
    return pa.RecordBatch.from_arrays(
        [signed(keys[start]), pa.array(low), pa.array(high, mask=one), pa.array(bits, mask=one)], ["key", "node", "last", "bits"]
    )


def _filters(keys: DataFrame, *columns: str) -> list[tuple[np.ndarray, np.uint64]]:
    """A filter of the keys, and one of those for which a column holds, for each: the words, and by how much a key's place is too long for them. A key
    sets three bits of one of 16 to 32 a key, up to MOST_BITS."""
    counts = keys.agg(F.count(F.lit(1)), *[F.count_if(c) for c in columns]).collect()[0]
    shifts = [np.uint64(MOST_BITS - min(MOST_BITS, max(16, (16 * n).bit_length()))) for n in counts]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rows = batch.column("key").to_numpy().view(np.uint64), []
            for k, shift in enumerate(shifts):
                own = key[batch.column(columns[k - 1]).to_numpy(zero_copy_only=False)] if k else key
                if len(own):
                    at, bits = _place(own, shift)
                    order = np.argsort(at, kind="stable")
                    at, bits = at[order], bits[order]
                    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    rows.append((k, at[start].tobytes(), np.bitwise_or.reduceat(bits, start).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["k", "at", "bits"])

    out = [np.zeros(1 << (PLACE - int(shift)), np.uint64) for shift in shifts]
    for batch in keys.mapInArrow(emit, "k int, at binary, bits binary").toArrow().to_batches():  # a word is in a few rows: keys are in order of their places
        for k, at, bits in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "bits")), strict=True):
            out[k][np.frombuffer(at, np.int64)] |= np.frombuffer(bits, np.uint64)
    return list(zip(out, shifts, strict=True))


def _place(keys: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A key's word in a filter, and its bits there."""
    one, bit = np.uint64(1), np.uint64(63)
    at = (keys & np.uint64((1 << PLACE) - 1)) >> shift
    return at.astype(np.int64), one << (keys >> np.uint64(PLACE) & bit) | one << (keys >> np.uint64(PLACE + 6) & bit) | one << (keys >> np.uint64(PLACE + 12) & bit)


def _has(held: tuple[np.ndarray, np.uint64], keys: np.ndarray) -> np.ndarray:
    at, bits = _place(keys, held[1])
    return held[0][at] & bits == bits


def _windows(texts: DataFrame, keys: DataFrame, size: int, least: int) -> DataFrame:
    """The windows whose keys more than one node has and that aren't hot; and, as `part` of rows without a key, the shingles from lc on of each run of
    stretches of the least length that a window of a hot key holds. The filter says what is hot, for both alike."""
    every, hot_ones = _filters(keys, "hot")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, s, bounds in _texts(batches, size, least):
            rows = []
            cover = np.zeros(len(s) + 1, np.int64)
            for f, seed in enumerate(_SEEDS):
                h = mix(s ^ seed)
                l, c, r = compact_windows(h, bounds, least)
                own = _has(every, h[c])
                l, c, r = l[own], c[own], r[own]
                hot = _has(hot_ones, h[c])
                np.add.at(cover, np.maximum(l, c - least + 1)[hot], 1)
                np.add.at(cover, np.minimum(c, r - least + 1)[hot] + 1, -1)
                l, c, r = l[~hot], c[~hot], r[~hot]
                key, doc, l, c, r, spans = _spanned(h[c], np.searchsorted(bounds, c, "right") - 1, l, c, r)
                begin = bounds[doc]
                rows.append(
                    [
                        signed(key), pa.array(nodes[doc]), pa.array((l - begin) << 32 | (c - begin)),
                        pa.array((r - begin) << 8 | np.where(spans, SPANS, 0) | f), pa.nulls(len(key), pa.binary())
                    ]
                )
            starts = np.flatnonzero(np.cumsum(cover)[: len(s)] > 0)
            doc = np.searchsorted(bounds, starts, "right") - 1
            cut = (np.diff(starts) != 1) | (np.diff(doc) != 0) | ((starts - bounds[doc])[1:] % RUN == 0)
            first = np.flatnonzero(np.append(True, cut)[: len(starts)])
            last = np.append(first[1:], len(starts))[: len(first)] - 1
            parts = [s[a : b + least].tobytes() for a, b in zip(starts[first], starts[last], strict=True)]
            none = pa.nulls(len(first), pa.int64())
            rows.append([none, pa.array(nodes[doc[first]]), pa.array(starts[first] - bounds[doc[first]]), none, pa.array(parts, pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], ["key", "node", "lc", "rf", "part"])

    return save(texts.mapInArrow(emit, WINDOW), "windows")


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all parts of a batch, and bounds."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("part")]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that link what the edges u, v link: each name but the least of a component, and that one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, up = at[: len(u)], at[len(u) :], np.arange(len(names))
    while ((p := up[x]) != (q := up[y])).any():
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up != up[up]).any():
            up = up[up]
    own = up != np.arange(len(names))
    return names[own], names[up[own]]


def _stretches(rest: DataFrame, reps: DataFrame, least: int, similarity: float) -> DataFrame:
    """What the exact way looks at, of runs (node, lc, part). Shingles are in one order: those that few nodes have, then others. A stretch's rarest
    ones are so many of the first shared ones that a similar stretch shares one of them, and has it among its own.

    kind 0: a shingle (key) that few nodes have, and the place in a text of stretches of which it is a rarest one.
    kind 1: a stretch with others among its rarest, the least doc_id of its text (rep), its class (key), and whether members of its class are similar
    (solid).
    kind 2: a class, the rarest shingles of it that many nodes have (tokens), how many are shared (held), the size of its sets, and as BITS the 256 bits
    of its shared shingles.
    kind 3: two classes (key, up) that a chain of similar stretches, each the next one of a text, links in the task's texts; a task has as few as link all.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in slices(batches, "part", 8 * COUNTED):
            s, bounds = _parts(batch)
            yield s, np.repeat(batch.column("node").to_numpy(), np.diff(bounds))

    shared = _shared(rest, own, "shared")
    filters = _filters(shared, "hot", "many")
    drop(shared)
    zero, one = np.uint64(0), np.uint64(1)
    names = [c.split()[0] for c in STRETCH.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.int32()]

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["key"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in zip(names, kinds, strict=True)], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        links, n_links = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))], 0
        for batch in slices(batches, "part", SLICE_BYTES // 8):
            s, bounds = _parts(batch)
            nodes, base, reps_ = (batch.column(c).to_numpy() for c in ("node", "lc", "rep"))
            is_shared, is_hot, is_many = (_has(held, s) for held in filters)
            level = np.where(is_shared, np.where(is_hot, np.where(is_many, 2, 1), 0), 3).astype(np.uint64)
            value = level << np.uint64(62) | mix(s) >> np.uint64(2)
            per = np.diff(bounds) - least + 1
            run = np.repeat(np.arange(len(per)), per)
            at = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per) + bounds[run]
            some = np.append(0, np.cumsum(is_shared))
            some = np.flatnonzero(some[at + least] > some[at])
            run, at = run[some], at[some]
            sets = np.sort(value[at[:, None] + np.arange(least)], axis=1)
            first = np.ones(sets.shape, bool)
            first[:, 1:] = sets[:, 1:] != sets[:, :-1]
            size = first.sum(1)
            own = first & (sets < np.uint64(3) << np.uint64(62))
            held = own.sum(1)
            need = np.ceil(similarity * size - 1e-9).astype(np.int64)
            may = np.flatnonzero(held >= need)
            run, at, sets, own, size, held, need = (x[may] for x in (run, at, sets, own, size, held, need))
            rare = own & (np.cumsum(own, axis=1) <= (held - need + 1)[:, None])
            cold = sets < np.uint64(1) << np.uint64(62)
            start = at - bounds[run] + base[run]

            row, col = np.nonzero(rare & cold)
            key, of = sets[row, col], run[row]
            order = np.lexsort((row, key, of))
            key, of, begin = key[order], of[order], start[row[order]]
            group = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(key)])
            low, high = begin[group], begin[np.append(group[1:], len(key))[: len(group)] - 1]
            yield batch_of(
                kind=pa.array(np.zeros(len(group), np.int32)), key=signed(key[group]), node=pa.array(nodes[of[group]]), lc=pa.array(low << 32 | low),
                rf=pa.array((high + least - 1) << 8 | WHOLE)
            )

            row = np.flatnonzero((rare & ~cold).any(1))
            sets, own, rare, size, held, start, run = sets[row], own[row], (rare & ~cold)[row], size[row], held[row], start[row], run[row]
            name = mix(np.where(own, mix(sets), np.uint64(0)).sum(1, dtype=np.uint64) ^ mix(size.astype(np.uint64)))
            solid = held >= similarity * (2 * size - held) - 1e-9
            # a stretch and the next one differ by a shingle each, so they are similar where they are large enough
            goes_on = np.append(False, (np.diff(start) == 1) & (run[1:] == run[:-1]) & solid[1:] & solid[:-1] & (size[:-1] - 1 >= similarity * (size[:-1] + 1)))
            up = name[np.maximum.accumulate(np.where(goes_on[: len(row)], 0, np.arange(len(row))))] if len(row) else name
            yield batch_of(
                kind=pa.array(np.ones(len(row), np.int32)), key=signed(name), node=pa.array(nodes[run]), lc=pa.array(start << 32 | start),
                rf=pa.array((start + least - 1) << 8 | WHOLE), rep=pa.array(reps_[run]), solid=pa.array(solid)
            )
            links.append((name[name != up], up[name != up]))
            n_links += len(links[-1][0])
            if n_links >= COUNTED:
                links, n_links = [_forest(*map(np.concatenate, zip(*links, strict=True)))], 0

            _, once = np.unique(name, return_index=True)
            once = np.array([k for k in once.tolist() if int(name[k]) not in told], np.int64)
            if len(told) > TOLD:
                told.clear()
            told.update(name[once].tolist())
            place = mix(sets[once])
            bit, word = np.where(own[once], one << (place & np.uint64(63)), zero), place >> np.uint64(62)
            bits = {c: signed(np.bitwise_or.reduce(np.where(word == np.uint64(k), bit, zero), axis=1)) for k, c in enumerate(BITS)}
            rare = rare[once]
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare.sum(1))).astype(np.int32)), signed(sets[once][rare]))
            yield batch_of(
                kind=pa.array(np.full(len(once), 2, np.int32)), key=signed(name[once]), tokens=tokens, size=pa.array(size[once].astype(np.int32)),
                held=pa.array(held[once].astype(np.int32)), **bits
            )
        u, v = _forest(*map(np.concatenate, zip(*links, strict=True)))
        yield batch_of(kind=pa.array(np.full(len(u), 3, np.int32)), key=signed(u), up=signed(v))

    return save(rest.join(reps.select("node", "rep"), "node").mapInArrow(emit, STRETCH), "stretches")


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows in order of key and node: each with every other one of its key and another node. A key has few nodes here, and a node few windows
    of a key."""
    names = ("key", "node", "lc", "rf")

    def paired(rows: np.ndarray) -> pa.RecordBatch:
        if rows.shape[1]:
            rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])]  # copies of a node in several tasks
        own, other, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        while k < rows.shape[1]:
            at = np.flatnonzero(rows[0, k:] == rows[0, :-k]) + k
            if not len(at):
                break
            own.append(at)
            other.append(at - k)
            k += 1
        own, other = np.concatenate(own), np.concatenate(other)
        real = rows[1, own] != rows[1, other]
        own, other = own[real], other[real]  # nodes rise, so own's is the larger
        return pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (rows[1, own], rows[1, other], rows[2, own], rows[3, own], rows[2, other], rows[3, other])],
            ["a", "b", "lc", "rf", "lc2", "rf2"]
        )

    held = np.zeros((4, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
        if not rows.shape[1]:
            continue
        cut = np.flatnonzero(rows[0] != rows[0, -1])  # the last key may go on in the next batch
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = rows[:, cut:]
        yield paired(rows[:, :cut])
    yield paired(held)


PAIR = "a bigint, b bigint, lc bigint, rf bigint, lc2 bigint, rf2 bigint"


def _turned(both: DataFrame) -> DataFrame:
    """Pairs of windows x (node, lc, rf) and y, the larger node first, as in _partners()."""
    turned = F.col("x.node") < F.col("y.node")
    pick = lambda x, y, c: F.when(turned, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    sides = [(x, y, c, n) for x, y, names in (("x", "y", ("a", "lc", "rf")), ("y", "x", ("b", "lc2", "rf2"))) for c, n in zip(("node", "lc", "rf"), names, strict=True)]
    return both.where("x.rep <> y.rep").select(*[pick(x, y, c).alias(n) for x, y, c, n in sides]).select("a", "b", "lc", "rf", "lc2", "rf2")


def _similar(near: DataFrame, first: DataFrame, runs: DataFrame, least: int, similarity: float) -> DataFrame:
    """Of near pairs of classes (p, q in components cp, cq) one that is similar for each pair of components, and whether q is solid. The sets of their
    first stretches are cut out of the runs and compared as a whole; their intersection is that of any members, except where both lie in one text: such
    pairs all stay. Two solid classes whose first stretches lie in one document make no pair."""
    classes = near.select(F.col("p").alias("key")).unionByName(near.select(F.col("q").alias("key"))).distinct()
    place = (F.shiftright("y.lc", 32) - F.col("run.lc")).cast("int")
    sets = first.join(classes, "key", "left_semi").alias("first").join(runs.alias("run"), F.col("first.y.node") == F.col("run.node")).where(
        (place >= 0) & (place <= F.octet_length("part") / 8 - least)
    ).select(
        "key", "solid", "y.rep", "y.node", F.substring("part", 8 * place + 1, F.lit(8 * least)).alias("part")
    ).groupBy("key").agg(*[F.first(c).alias(c) for c in ("solid", "rep", "node", "part")])  # rows are cut before this sorts them: a run has up to 64 KB
    side = lambda key: sets.select(F.col("key").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("solid", "rep", "node", "part")])
    both = near.join(side("p"), "p").join(side("q"), "q").where("not (p_solid and q_solid and p_rep = q_rep)")
    names = ["p", "q", "cp", "cq", "q_solid", "sure"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "p_part", SLICE_BYTES):
            x, y = (np.sort(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, least), axis=1) for c in ("p_part", "q_part"))
            n, m, union = (1 + (s[:, 1:] != s[:, :-1]).sum(1) for s in (x, y, np.sort(np.concatenate([x, y], axis=1), axis=1)))
            sure = batch.column("p_node").to_numpy() != batch.column("q_node").to_numpy()
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(sure)], names)
            yield out.filter(pa.array(~sure | (n + m - union >= similarity * union - 1e-9)))

    found = both.mapInArrow(compare, "p bigint, q bigint, cp bigint, cq bigint, q_solid boolean, sure boolean")
    apart = [F.when(~F.col("sure"), F.col(c)).alias(f"own_{c}") for c in ("p", "q")]
    found = found.groupBy("cp", "cq", *apart).agg(F.min(F.struct("p", "q", "q_solid")).alias("one"))
    return save(found.select("one.*"), "similar")


def _class_pairs(stretches: DataFrame, runs: DataFrame, least: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of stretches of classes, and tables to drop: each one of a solid class with its first (by the least doc_id), and of two components, which
    are classes that chains of similar stretches link, a pair of similar classes. Firsts are gathered within tasks and joined as a table, so a class of a
    third of all rows is split."""
    window = F.struct("rep", "node", "lc", "rf")
    rows = stretches.where("kind = 1").select("key", "solid", window.alias("x"))
    first = save(rows.groupBy("key").agg(F.min("x").alias("y"), F.first("solid").alias("solid")), "firsts")
    starred = _turned(rows.where("solid").join(first.select("key", "y"), "key"))

    linked = components(stretches.where("kind = 3").select(F.col("key").alias("u"), F.col("up").alias("v")))
    bits = [f"bits{k}" for k in range(len(BITS))]
    classes = save(
        stretches.where("kind = 2").dropDuplicates(["key"]).join(linked, F.col("key") == F.col("id"), "left").select(
            "key", "tokens", "held", "size", *[F.col(c).alias(b) for c, b in zip(BITS, bits, strict=True)], F.coalesce("component", "key").alias("component")
        ),
        "classes"
    )
    drop(linked)
    # so many of a class's shared shingles come from a token on, and are all that it shares with another class whose first common token that is
    left = F.ceil(similarity * F.col("size") - 1e-9) + F.size("tokens") - 1 - F.col("at")
    alike = lambda x, y: similarity / (1 + similarity) * (F.col(x) + F.col(y)) - 1e-9  # noqa: E731  what similar sets of these sizes share
    tokens = classes.select("*", F.posexplode("tokens").alias("at", "token")).withColumn("left", left).drop("tokens", "at")
    tokens = tokens.join(tokens.groupBy("token").agg(F.min("size").alias("least")), "token").where(F.col("left") >= alike("size", "least"))
    tokens = save(tokens, "tokens")
    mixed = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    mixed = tokens.join(mixed, "token")
    share = alike("x.size", "y.size")
    # a shingle that one of them has and the other hasn't changes a bit at most
    apart = sum(F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits)
    met = mixed.alias("x").join(mixed.alias("y"), F.col("x.token") == F.col("y.token")).where(
        (F.col("x.component") < F.col("y.component")) & (F.least("x.left", "y.left") >= share) & (apart <= F.col("x.held") + F.col("y.held") - 2 * share)
    )
    near = save(met.select(*[F.col(c).alias(n) for c, n in (("x.key", "p"), ("y.key", "q"), ("x.component", "cp"), ("y.component", "cq"))]).distinct(), "near")
    similar = _similar(near, first, runs, least, similarity)
    # members of a class that isn't solid are each similar to the other class's, but not to one another
    both = similar.select("p", "q").unionByName(similar.where("not q_solid").select(F.col("q").alias("p"), F.col("p").alias("q")))
    members = first.where("solid").select(F.col("key").alias("p"), F.col("y").alias("x")).unionByName(
        rows.where("not solid").select(F.col("key").alias("p"), "x")
    )
    across = _turned(both.join(members, "p").join(first.select(F.col("key").alias("q"), "y"), "q"))
    return starred.unionByName(across), [first, classes, tokens, near, similar]


def _window_pairs(windows: DataFrame, reps: DataFrame, least: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of windows, and tables to drop once these are written."""
    runs = windows.where("key is null").select("node", "lc", "part")
    stretches = _stretches(runs, reps, least, similarity)
    columns = ("key", "node", "lc", "rf")
    few = windows.where("key is not null").select(*columns).unionByName(stretches.where("kind = 0").select(*columns))
    few = few.repartition("key").sortWithinPartitions(*columns).mapInArrow(_partners, PAIR)
    classes, scratch = _class_pairs(stretches, runs, least, similarity)
    return few.unionByName(classes), [stretches, *scratch]


def _agree(f: np.ndarray, windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether windows of at least AGREE functions hold a common pair of places, for each group bounds[g]:bounds[g + 1].

    windows: l, c0, c1, r in the one document and in the other, in rows. The pair of places that is looked at is a window's own, c0 to c1 in either
    document.
    """
    size = np.diff(bounds)
    vote = np.where(f == WHOLE, ((1 << AGREE) - 1) << WHOLE, 1 << f)
    seen = np.bitwise_or.reduceat(vote, bounds[:-1]) if len(size) else np.zeros(0, np.int64)
    some = np.bitwise_count(seen) >= AGREE
    out = np.zeros(len(size), bool)

    def hold(x, y):
        """Whether window x holds the places of window y, or some of them."""
        l, _, _, r, l2, _, _, r2 = windows[:, x]
        _, c0, c1, _, _, d0, d1, _ = windows[:, y]
        return (l <= c1) & (c0 <= r) & (l2 <= d1) & (d0 <= r2)

    few = np.flatnonzero(some & (size <= AT_ONCE))
    for part in np.array_split(few, max(1, int((size[few] ** 2).sum()) // 1_000_000)):
        m = size[part]
        cells = m * m
        group = np.repeat(np.arange(len(part)), cells)
        k = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        x, y = bounds[part][group] + k % m[group], bounds[part][group] + k // m[group]
        if len(x):
            row = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            agreed = np.bitwise_count(np.bitwise_or.reduceat(np.where(hold(x, y), vote[x], 0), row)) >= AGREE
            np.logical_or.at(out, part[group[row]], agreed)
    for g in np.flatnonzero(some & (size > AT_ONCE)):
        rows = np.arange(bounds[g], bounds[g + 1])
        out[g] = any(np.bitwise_count(np.bitwise_or.reduce(np.where(hold(rows, y), vote[rows], 0))) >= AGREE for y in rows)
    return out


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From window pairs in order of their two documents: the pairs of documents on which enough functions agree, and the stretch of each that the
    windows cover."""
    names = ["a", "b", "lc", "rf", "lc2", "rf2"]

    def made(rows: np.ndarray) -> pa.RecordBatch:
        bounds = np.append(
            np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])), rows.shape[1]
        ) if rows.shape[1] else np.zeros(1, np.int64)
        windows = np.concatenate([_unpacked(*rows[2:4]), _unpacked(*rows[4:6])])
        good = np.flatnonzero(_agree(rows[3] & 31, windows, bounds))
        at = bounds[:-1]
        ends = [fn.reduceat(windows[k], at)[good] if len(at) else at for k, fn in ((0, np.minimum), (3, np.maximum), (4, np.minimum), (7, np.maximum))]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[0, at[good]], rows[1, at[good]], *ends)], ["a", "b", "a0", "a1", "b0", "b1"])

    held = np.zeros((6, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
        if not rows.shape[1]:
            continue
        cut = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0))  # the last pair may go on in the next batch
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = rows[:, cut:]
        yield made(rows[:, :cut])
    yield made(held)


def _longest(hit: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch [i, j) whose mean is at least share; it starts and ends with a hit."""
    p = np.concatenate([[0.0], np.cumsum(hit - share)])
    low = np.minimum.accumulate(p)
    first = np.searchsorted(-low, -p - 1e-9, "left")
    length = np.arange(len(p)) - first
    j = int(length.argmax())
    i = int(first[j])
    while i < j and not hit[i]:
        i += 1
    while j > i and not hit[j - 1]:
        j -= 1
    return i, j


def _dense(hit: np.ndarray, share: float) -> np.ndarray:
    """Places that some stretch holds whose mean is at least share."""
    p = np.concatenate([[0.0], np.cumsum(hit - share)])
    return np.maximum.accumulate(p[::-1])[::-1][1:] - np.minimum.accumulate(p)[:-1] > -1e-9


def _runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places i, k and lengths n, in rows, of the longest runs x[i:i + n] == y[k:k + n], by i."""
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(x)), n)
    k = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    by = np.lexsort((i, k - i))
    i, k = i[by], k[by]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(k - i) != 0)])) if len(i) else np.zeros(0, np.int64)
    runs = np.stack([i[start], k[start], np.diff(np.append(start, len(i)))])
    return runs[:, np.argsort(runs[0], kind="stable")]


def _neighbours(i: np.ndarray, k: np.ndarray, n: np.ndarray, far: int) -> tuple[list[int], list[int]]:
    """Of each of a few runs the nearest one after it and before it that is no farther than `far` in either text, or -1: all pairs of runs at once."""
    dx, dy = i - (i + n)[:, None], k - (k + n)[:, None]
    fits = (np.minimum(dx, dy) >= -4) & (np.maximum(dx, dy) <= far) & (i > i[:, None]) & (k > k[:, None])
    cost = np.where(fits, dx + dy, 2 * far + 1)
    return tuple(np.where(fits.any(axis), cost.argmin(axis), -1).tolist() for axis in (1, 0))


class _Pair:
    """The shingles of two stretches as small numbers, so that sets of them are tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        names, every = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.x, self.y, self.n = every[: len(x)], every[len(x) :], len(names)

    def held(self, values: np.ndarray) -> np.ndarray:
        table = np.zeros(self.n, bool)
        table[values] = True
        return table

    def likeness(self, i: int, j: int, k: int, m: int) -> float:
        p, q = self.held(self.x[i:j]), self.held(self.y[k:m])
        return float((p & q).sum() / max(1, (p | q).sum()))

    def best_part(
        self, i: np.ndarray, k: np.ndarray, n: np.ndarray, a: int, least: int, similarity: float, over: int
    ) -> tuple[int, int, int, int, int, float] | None:
        """The longest similar part of a chain of runs that is longer than `over`: its length, place and likeness. From each run on, the sets of all parts are made at once."""
        ends, y_ends = i + n, k + n
        if min(ends[-1] - i[0], y_ends[-1] - k[0]) < max(least, over + 1):
            return None
        x, y = self.x[a + i[0] : a + ends[-1]], self.y[k[0] : y_ends[-1]]
        names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = both[: len(x)], both[len(x) :]
        held = np.zeros((4, len(i), len(names)), bool)  # up to the next run, and the run alone, in either text
        for r in range(len(i)):
            at, y_at = i[r] - i[0], k[r] - k[0]
            held[1, r, x[at : at + n[r]]] = held[3, r, y[y_at : y_at + n[r]]] = True
            if r + 1 < len(i):
                held[0, r, x[at : i[r + 1] - i[0]]] = held[2, r, y[y_at : k[r + 1] - k[0]]] = True
        best = None
        for f in range(len(i)):
            length = np.minimum(ends[f:] - i[f], y_ends[f:] - k[f])
            may = np.flatnonzero(length >= max(least, over + 1))
            if not len(may):
                continue
            to = int(may[-1]) + 1
            sets = []
            for way in (0, 2):
                own = held[way + 1, f : f + to].copy()
                own[1:] |= np.logical_or.accumulate(held[way, f : f + to - 1], axis=0)
                sets.append(own)
            likeness = (sets[0] & sets[1]).sum(1) / (sets[0] | sets[1]).sum(1)
            good = may[likeness[may] >= similarity]
            if len(good):
                g = int(good[np.argmax(length[good])])
                over = int(length[g])
                best = (over, a + int(i[f]), a + int(ends[f + g]), int(k[f]), int(y_ends[f + g]), float(likeness[g]))
        return best

    def by_runs(self, a: int, b: int, on: np.ndarray, y_on: np.ndarray, least: int, similarity: float) -> tuple[int, int, int, int, float] | None:
        """The longest similar stretch of x[a:b] among chains of runs.

        An edit takes five shingles from a text and leaves as many others, so stretches of the least length that are similar enough have one edit or
        two, and a run of over a third of that length. Each such
        run is followed to both sides, to the nearest run that is no farther than an edit and a half in either text; of a chain, every part that
        starts with one run and ends with another is tried, the longest first.
        """
        x = np.where(on, self.x[a:b], -1)
        i, k, n = _runs(x, np.where(y_on, self.y, -2))
        far, seeds, used = 8, np.flatnonzero(n >= least // 3), np.zeros(len(i), bool)
        best = None

        if not len(seeds):
            return None
        few = len(i) <= FEW
        if few:
            after, before = _neighbours(i, k, n, far)
        else:
            by_end = np.argsort(i + n, kind="stable")
            ends = (i + n)[by_end]
        tried: set[int] = set()

        def next_run(at: int, step: int) -> int:
            """The nearest run on that side of many, or -1."""
            if step > 0:  # runs are in order of i
                near = np.arange(*np.searchsorted(i, [i[at] + n[at] - 4, i[at] + n[at] + far + 1]))
                dx, dy = i[near] - (i[at] + n[at]), k[near] - (k[at] + n[at])
                further = (i[near] > i[at]) & (k[near] > k[at])
            else:
                near = np.sort(by_end[slice(*np.searchsorted(ends, [i[at] - far, i[at] + 5]))])
                dx, dy = i[at] - (i[near] + n[near]), k[at] - (k[near] + n[near])
                further = (i[near] < i[at]) & (k[near] < k[at])
            fits = np.flatnonzero(further & (dx >= -4) & (dx <= far) & (dy >= -4) & (dy <= far))
            return int(near[fits[np.argmin(dx[fits] + dy[fits])]]) if len(fits) else -1

        def follow(at: int, step: int) -> list[int]:
            out = []
            if few:
                to = after if step > 0 else before
                while (at := to[at]) >= 0:
                    out.append(at)
                return out
            while (at := next_run(at, step)) >= 0:
                out.append(at)
            return out

        for seed in seeds[np.argsort(-n[seeds], kind="stable")].tolist():
            if used[seed]:
                continue
            chain = [*follow(seed, -1)[::-1], seed, *follow(seed, 1)]
            used[chain] = True
            last, first = chain[-1], chain[0]
            texts = hash((self.x[a + i[first] : a + i[last] + n[last]].tobytes(), self.y[k[first] : k[last] + n[last]].tobytes()))
            if texts in tried:  # a longer part than the one found isn't in it
                continue
            tried.add(texts)
            best = max(filter(None, (best, self.best_part(i[chain], k[chain], n[chain], a, least, similarity, best[0] if best else 0))), default=None)
        return best and best[1:]


def near_passages(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches x[i:j], y[k:m] of at least `least` shingles and of that Jaccard similarity of their sets, apart from each other in x.

    Of each gap only places stay, in both texts, that lie in a stretch with enough shingles of the other's. The longest such stretch is tried at three
    shares, and where none of these passes, chains of equal runs."""
    pair = _Pair(x, y)
    out, gaps, whole_y = [], [(0, len(x))], pair.held(pair.y)
    # so many of `least` places that lie in stretches of that share of hits, which may overlap, are hits
    enough = similarity / (2 - similarity) * least - 1e-6
    while gaps:
        a, b = gaps.pop()
        if b - a < least:
            continue
        own = pair.x[a:b]
        if whole_y[own].sum() < enough:
            continue
        on, y_on, before = np.ones(b - a, bool), np.ones(len(y), bool), -1
        while before != (before := (n := int(on.sum())) + (m := int(y_on.sum()))) and n >= least and m >= least:
            hit = on & pair.held(pair.y[y_on])[own]
            on = on & _dense(hit, similarity)
            y_hit = y_on & pair.held(own[on])[pair.y]
            y_on = y_on & _dense(y_hit, similarity)
        if n < least or m < least:
            continue
        for share in (similarity, (1 + similarity) / 2, 1.0):
            i, j = _longest(hit, share)
            if j - i < least:
                continue
            k, m = _longest(pair.held(own[i:j])[pair.y], share)
            if m - k < least:
                continue
            found = pair.likeness(a + i, a + j, k, m)
            if found >= similarity:
                i, j = a + i, a + j
                break
        else:
            held = pair.by_runs(a, b, on, y_on, least, similarity)
            if held is None:
                continue
            i, j, k, m, found = held
        out.append((i, j, k, m, found))
        gaps += [(a, i), (j, b)]
    return out


def repeated_passages(docs: DataFrame, size: int = 5, similarity: float = 0.8, least_words: int = 50) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end, similarity: passages of least_words words or more that are near duplicates of a passage
    of another document.

    Words are counted from 0, end is not in the passage. doc_id > other_id. Of equal texts the one of least doc_id stands for all; each other one has
    one row, its whole text as a passage of that one.
    Windows of a key that about MEET nodes have are all compared. Stretches of the least length in windows of a key that more nodes have are compared by an
    exact join of their sets of shingles, so that a pair of similar stretches of that length is missed with probability 0.0016 at most, whatever their
    keys, and never where they share a hot one. A passage that a third of the documents share costs a few rows a document: stretches of
    a class are linked with its first, and of two components of classes one similar pair is compared. So links between classes that are linked otherwise may
    have no row of their own.
    Verification is exact, on the shingles of both stretches. A null text counts as empty; texts of under least_words words have no
    passage. Rows with a null doc_id take no part. Rows with the same doc_id are not compared with each other; where such texts differ, each of them
    is compared. Repeated rows count once. Other columns are not looked at.
    """
    least = least_words - size + 1
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).where("doc_id is not null").withColumn("node", F.xxhash64("text"))
    named = save(texts.select("doc_id", "node", "text").mapInArrow(_with_words, "doc_id bigint, node bigint, words int"), "named")
    reps = save(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "representatives")
    copies = named.where(F.col("words") >= least_words).join(
        reps.where("rep <> last").select("node", "rep"), "node"
    ).where("doc_id <> rep").dropDuplicates(["doc_id", "node"])
    zero, words = F.lit(0).cast("bigint"), F.col("words").cast("bigint")
    copies = copies.select(
        "doc_id", zero.alias("start"), words.alias("end"), F.col("rep").alias("other_id"), zero.alias("other_start"), words.alias("other_end"),
        F.lit(1.0).alias("similarity")
    )

    keys = _counted_keys(texts.select("node", "text"), size, least)
    windows = _windows(texts.select("node", "text"), keys, size, least)
    drop(keys)
    pairs, scratch = _window_pairs(windows, reps, least, similarity)
    regions = save(
        pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(
            _regions, "a bigint, b bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint"
        ),
        "regions"
    )
    drop(windows, *scratch)
    rep = lambda side: reps.select(F.col("node").alias(side), F.col("rep").alias(f"{side}_id"))
    pairs = regions.join(rep("a"), "a").join(rep("b"), "b").where("a_id <> b_id")

    def side(k: int, own: str) -> DataFrame:
        """Side 0 of a pair is the later document. A window may end inside of a passage, so a stretch's length is added at both ends."""
        lo, hi = F.greatest(F.lit(0), F.col(f"{own}0") - least), F.col(f"{own}1") + least
        return pairs.select(
            F.col(own).alias("node"), F.col(f"{own}_id").alias("own"), F.greatest("a_id", "b_id").alias("doc_id"),
            F.least("a_id", "b_id").alias("other_id"), "a", "b",
            F.when(F.col(f"{own}_id") == F.greatest("a_id", "b_id"), 0).otherwise(1).alias("side"), lo.alias("lo"), hi.alias("hi")
        )

    sides = save(side(0, "a").unionByName(side(1, "b")), "sides")
    drop(regions)
    bits = id_bits(sides, "own")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(bits, batch.column("_slot").to_numpy(zero_copy_only=False)))).select(["doc_id", "node", "text"])

    columns = ["doc_id", "other_id", "a", "b", "side", "lo"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.stack([batch.column(c).to_numpy() for c in ("own", "node")])
            run = np.cumsum(np.concatenate([[0], (own[:, 1:] != own[:, :-1]).any(0)]))  # rows of one document follow each other
            texts = batch.column("text").take(pa.array(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))))
            s, bounds = shingles(*hash_words(texts), size)
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            parts = [s[bounds[d] + x : min(bounds[d] + y + 1, bounds[d + 1])].tobytes() for d, x, y in zip(run, lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(parts, pa.binary())], [*columns, "part"])

    held = with_slot(texts, "doc_id").mapInArrow(sift, "own bigint, node bigint, text string")  # repeated rows are passed over in verify()
    parts = held.join(sides, ["own", "node"]).mapInArrow(cut, "doc_id bigint, other_id bigint, a bigint, b bigint, side int, lo bigint, part binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        last = done = None  # the one side of a pair, whose other side comes next; and the pair that is done
        for batch in slices(batches, "part"):
            rows = set()
            for doc, other, a, b, which, lo, part in zip(*(batch.column(c).to_pylist() for c in (*columns, "part")), strict=True):
                own = np.frombuffer(part, np.uint64)
                if which and last and last[:2] == (a, b) and done != (a, b):
                    done = (a, b)
                    for i, j, k, m, s in near_passages(last[3], own, least, similarity):
                        rows.add((doc, last[2] + i, last[2] + j + size - 1, other, lo + k, lo + m + size - 1, s))
                elif not which:
                    last = (a, b, lo, own)
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    together = parts.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return together.mapInArrow(
        verify, "doc_id bigint, start bigint, end bigint, other_id bigint, other_start bigint, other_end bigint, similarity double"
    ).unionByName(copies)
