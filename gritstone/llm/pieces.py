"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch that no piece crosses are laid end to end and indexed by a suffix array; every piece of the vocabulary is
binary-searched
for the range of its occurrences; the resulting edges are sorted by where they end and relaxed from left to right. For
a byte-pair model the relaxation keeps, at each place, the one piece with which the merges would end there: pieces may follow
each other if merging the two alone gives back the two. For a unigram model it keeps the best sum of scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, slices

SPACE = "▁"
#: Bytes of text that are cut at a time, characters of new stretches that are indexed at a time, and distinct stretches that a task remembers.
CHUNK_BYTES, INDEX_CHARS, REMEMBERED = 1 << 21, 1 << 19, 300_000
#: Slots for verdicts on pairs of pieces (9 bytes each).
PAIR_BITS = 22


class Verdicts:
    """A direct-mapped table of verdicts on pairs of pieces, of fixed size: a newer pair replaces the one in its slot."""

    def __init__(self) -> None:
        self.keys, self.ok = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    def of(self, keys: np.ndarray, judge: Callable[[int], bool]) -> np.ndarray:
        """keys are distinct."""
        slot = (mix(keys.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.ok[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        out[new] = [judge(k) for k in keys[new].tolist()]
        self.keys[slot[new]], self.ok[slot[new]] = keys[new], out[new]
        return out


#: Kept by worker processes from task to task, by model.
_PAIRS: dict[int, Verdicts] = {}


class Pieces:
    """A SentencePiece vocabulary: ids are positions in pieces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], unigram: bool = False, prefix: bool = True):
        """kinds: 'normal', 'byte' (a piece like <0x0A>), 'control' or 'unknown'."""
        self.pieces, self.unigram, self.prefix = pieces, unigram, prefix
        self.score = dict(zip(pieces, scores, strict=True))
        self.id = {p: k for k, p in enumerate(pieces) if kinds[k] == "normal"}
        self.scores = np.array(scores, float)
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(pieces) if kinds[k] == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        raw = {self.byte[b]: bytes([b]) for b in self.byte}
        self.raw = [
            raw.get(k, b"" if kinds[k] == "control" else " ⁇ ".encode() if kinds[k] == "unknown" else p.replace(SPACE, " ").encode()) for k,
            p in enumerate(pieces)
        ]
        known = {c for p in self.id for c in p} - {SPACE}
        inside = "".join(map(re.escape, sorted(known)))
        #: Stretches that no piece crosses: a piece has SPACE in front or not at all, and a character outside the vocabulary is alone.
        self.stretch = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]")
        self.known = known | {SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece with a blank inside it")
        self.longest = max(map(len, self.id))
        names = sorted(self.id)
        self.ids, self.sizes = np.array([self.id[p] for p in names]), np.array([len(p) for p in names])
        self.codes = np.zeros((len(names), self.longest), np.int64)  # characters, then zeros
        for k, p in enumerate(names):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.key = hash((tuple(pieces), tuple(scores)))

    @classmethod
    def load(cls, path: str) -> Pieces:
        """A model file of the SentencePiece library. Its normaliser must leave texts as they are; a model whose normaliser doesn't is an error, as
        its ids would be others."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        prefix = model.encode("a", out_type=str)[0].startswith(SPACE)
        probe = " \ufb03  \uff21a\u0301 \tb "
        if model.normalize(probe) != SPACE * prefix + probe.replace(" ", SPACE):
            raise ValueError(f"the normaliser of {path} changes texts")
        try:  # there is no list of best ways for byte-pair models
            unigram = bool(model.nbest_encode_as_ids("ab", 1))
        except RuntimeError:
            unigram = False
        kind = lambda k: "byte" if model.is_byte(k) else "unknown" if model.is_unknown(k) else "control" if model.is_control(k) or model.is_unused(k) else "normal"
        n = model.get_piece_size()
        return cls([model.id_to_piece(k) for k in range(n)], [model.get_score(k) for k in range(n)], [kind(k) for k in range(n)], unigram, prefix)

    def merged(self, text: str) -> list[str]:
        """The merges as byte-pair models make them: always the best-scored adjacent pair, of equals the leftmost. For short texts."""
        parts, score, at = list(text), self.score, self.id
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                pair = parts[k] + parts[k + 1]
                if pair in at and (best is None or score[pair] > best):
                    best, where = score[pair], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _follows(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging would keep each pair of pieces apart and whole; a key is left id + 1 (0: the start), times 2**20, plus right id."""

        def judge(key: int) -> bool:
            left, right = key >> 20, self.pieces[key & 0xFFFFF]
            want = [self.pieces[left - 1], right] if left else [right]
            return self.merged("".join(want)) == want

        if self.key not in _PAIRS:
            _PAIRS[self.key] = Verdicts()
        return _PAIRS[self.key].of(keys, judge)

    def _apart(self, text: str) -> list[int]:
        """Ids of a short stretch with characters that no piece holds alone: what is in no piece comes as bytes, or as unknown."""
        if self.unigram:
            best: list[tuple[float, list[int]]] = [(0.0, [])]
            worst = float(self.scores[list(self.id.values())].min()) - 10
            for end in range(1, len(text) + 1):
                ways = [
                    (
                        best[at][0] + self.score[text[at:end]], best[at][1] + [self.id[text[at:end]]]
                    ) for at in range(max(0, end - self.longest), end) if text[at:end] in self.id
                ]
                best.append(max([*ways, (best[-1][0] + worst, best[-1][1] + self._strange(text[end - 1]))], key=lambda w: w[0]))
            return best[-1][1]
        return [k for p in self.merged(text) for k in ([self.id[p]] if p in self.id else self._strange(p))]

    def _strange(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and id of every occurrence of every piece in the indexed text; code 0 is in no piece."""
        alphabet = np.unique(codes)
        alphabet = alphabet[alphabet > 0]
        n, bits = len(codes), max(1, int(len(alphabet)).bit_length())
        per = 64 // bits
        levels = -(-self.longest // per)
        symbols = np.zeros(n + per * levels, np.uint64)
        symbols[:n] = np.where(codes > 0, np.searchsorted(alphabet, codes) + 1, 0)
        keys = []
        for level in range(levels):
            key = np.zeros(n, np.uint64)
            for k in range(per):
                key = key << np.uint64(bits) | symbols[level * per + k : level * per + k + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])  # the suffix array, as far as the longest piece reaches
        keys = [k[suffixes] for k in keys]

        # Symbols of the pieces whose characters all occur; every level of a piece is a range of keys, as its symbols may be followed by any.
        at = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1) if len(alphabet) else np.zeros(self.codes.shape, np.int64)
        fits = (alphabet[at] == self.codes) | (self.codes == 0) if len(alphabet) else np.zeros(self.codes.shape, bool)
        own = np.flatnonzero(fits.all(1))
        if not len(own):
            return (np.zeros(0, np.int64),) * 3
        size, ids = self.sizes[own], self.ids[own]
        symbol = np.where(self.codes[own] > 0, at[own] + 1, 0).astype(np.uint64)
        symbol = np.pad(symbol, ((0, 0), (0, per * levels - symbol.shape[1])))
        for level in range(levels):
            v = np.zeros(len(own), np.uint64)
            for k in range(per):
                v = v << np.uint64(bits) | symbol[:, level * per + k]
            free = (np.clip(per * (level + 1) - size, 0, per) * bits).astype(np.uint64)  # bits after the piece's end
            top = v | np.where(free > 63, ~np.uint64(0), (np.uint64(1) << np.minimum(free, np.uint64(63))) - np.uint64(1))
            if level == 0:
                lo, hi = np.searchsorted(keys[0], v, "left"), np.searchsorted(keys[0], top, "right")
                continue
            for k in np.flatnonzero((size > level * per) & (lo < hi)):
                part = keys[level][lo[k] : hi[k]]
                lo[k], hi[k] = lo[k] + np.searchsorted(part, v[k], "left"), lo[k] + np.searchsorted(part, top[k], "right")
        count = hi - lo
        where = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        start = suffixes[where]
        return start, start + np.repeat(size, count), np.repeat(ids, count)

    def encode_stretches(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some distinct stretches."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if len(t) == 1 and t not in self.known:
                out[k] = np.array(self._strange(t), np.int32)
            else:
                plain.append(k)
        if not plain:
            return out
        codes = np.frombuffer("\0".join([texts[k] for k in plain]).encode("utf-32-le") + b"\0\0\0\0", np.uint32).astype(np.int64)
        size = np.array([len(texts[k]) for k in plain])
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        opens = np.repeat(first, size + 1)
        start, end, name = self.edges(codes)
        depth = end - opens[start]
        order = np.argsort(depth, kind="stable")
        start, end, name, depth = start[order], end[order], name[order], depth[order]
        cuts = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        last = np.full(len(codes) + 1, -2)  # the piece that ends here; -2: none, -1: the start
        last[first] = -1
        total = np.full(len(codes) + 1, -np.inf)
        total[first] = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, e, p = start[a:b], end[a:b], name[a:b]
            live = last[s] > -2
            s, e, p = s[live], e[live], p[live]
            if self.unigram:
                value = total[s] + self.scores[p]
                best = np.lexsort((p, -value, e))
                keep = best[np.concatenate([[True], e[best][1:] != e[best][:-1]])] if len(best) else best
                last[e[keep]], total[e[keep]] = p[keep], value[keep]
            elif len(s):
                keys, inverse = np.unique(((last[s] + 1) << 20) | p, return_inverse=True)
                ok = self._follows(keys)[inverse]
                last[e[ok]] = p[ok]
        length = np.array([len(p) for p in self.pieces])
        there = last[first + size] != -2
        for k in np.flatnonzero(~there):
            out[plain[k]] = np.array(self._apart(texts[plain[k]]), np.int32)
        plain, first, size = [k for k, ok in zip(plain, there, strict=True) if ok], first[there], size[there]
        at, rank = first + size, np.arange(len(plain))
        who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            p = last[at]
            who.append(rank)
            what.append(p)
            at = at - length[p]
            more = at > first[rank]
            at, rank = at[more], rank[more]
        who, what = np.concatenate(who)[::-1], np.concatenate(what)[::-1]
        order = np.argsort(who, kind="stable")
        what, bounds = what[order].astype(np.int32), np.searchsorted(who[order], np.arange(len(plain) + 1))
        for k, a, b in zip(plain, bounds, bounds[1:], strict=False):
            out[k] = what[a:b]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text: bytes joined, SPACE as a blank, less the blank that encoding put first. An id outside the vocabulary, or null, reads as the
        unknown piece."""
        raw, n = self.raw, len(self.raw)
        text = b"".join([raw[k] if k is not None and 0 <= k < n else " ⁇ ".encode() for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder:
    """Encodes batch after batch, and remembers the stretches it has seen."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.store, self.begin, self.size, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and len + 1 bounds; null and empty texts have none."""
        if len(self.index) > REMEMBERED:
            self.clear()
        cut = self.pieces.stretch.findall
        lead = SPACE if self.pieces.prefix else ""
        parts = [cut((lead + t).replace(" ", SPACE)) if t else [] for t in texts]
        index = self.index
        fresh = list(dict.fromkeys(x for row in parts for x in row if x not in index))
        if fresh:
            made = [m for part in _parts(fresh) for m in self.pieces.encode_stretches(part)]
            size = np.array([len(m) for m in made], np.int64)
            need = self.used + int(size.sum())
            if need > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(need, len(self.store)), np.int32)])
            self.store[self.used : need] = np.concatenate(made)
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used = need
            for x in fresh:
                index[x] = len(index)
        which = np.array([index[x] for row in parts for x in row], np.int64)
        size = self.size[which] if len(which) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(self.begin[which], size)] if len(which) else np.zeros(0, np.int32)
        return ids, total[np.concatenate([[0], np.cumsum([len(r) for r in parts])]).astype(np.int64)]


def _parts(stretches: list[str]) -> Iterator[list[str]]:
    """Runs of about INDEX_CHARS characters: the index takes some hundred bytes a character."""
    part, size = [], 0
    for x in stretches:
        part.append(x)
        size += len(x)
        if size >= INDEX_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, pieces: Pieces, column: str = "text", check: bool = False) -> DataFrame:
    """The columns of docs and _ids, the piece ids of its text; with check also _exact, whether decoding them gives the text back.

    Ids are those of the SentencePiece library. A null or empty text has no ids. The character U+2581 stands for a blank, so a
    text that holds it decodes to one with a blank there; all others come back exactly. Repeated rows are encoded one by one. Columns of docs named
    _ids or _exact are replaced, others pass through.
    """
    names = [c for c in docs.columns if c not in ("_ids", "_exact")]
    docs = docs.select(*names)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("_ids"), *[F.lit(None).cast("boolean").alias("_exact")] * check).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for held in slices(batches, column, CHUNK_BYTES):
            texts = held.column(column).to_pylist()
            ids, bounds = encoder.encode(texts)
            columns = [*held.columns, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
            if check:
                every = ids.tolist()
                columns.append(pa.array([pieces.decode(every[a:b]) == (t or "") for t, a, b in zip(texts, bounds, bounds[1:], strict=False)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "_ids", *["_exact"] * check])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, pieces: Pieces, column: str = "_ids", to: str = "text") -> DataFrame:
    """The columns of docs and the text of its ids. A null list has a null text, an empty one an empty text; ids outside the vocabulary, and null
    ones, read as the unknown piece."""
    names = [c for c in docs.columns if c != to]
    docs = docs.select(*names)
    schema = docs.select("*", F.lit(None).cast("string").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if row is None else pieces.decode(row) for row in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, to])

    return docs.mapInArrow(run, schema)
