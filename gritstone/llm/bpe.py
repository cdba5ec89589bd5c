"""Byte-pair encoding and decoding by speculation: propose, verify, and merge only what fails.

Greedy longest match proposes the tokens of all new words of a batch at once. A proposal is what the merges give if and only if every token is whole
under them and no merge crosses from a token to the next one; both are properties of two tokens, so all distinct neighbours are checked together, by
going back in time through the merges that made them. Only words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Unicode's White_Space. Fixed values.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts of a text where words hold no blanks.
WORDS = f"[^{BLANKS}]+"
#: Units that a task remembers, and characters of new words that are looked at together.
REMEMBERED, TOGETHER = 300_000, 1 << 19
#: Later than any merge.
NEVER = 1 << 40
#: Atoms of a word that are merged by looking at all pairs each time; those of a longer one are kept in a heap.
SHORT = 64
#: Added to the code of a word's last character where the model marks word ends; byte-level characters have codes below it.
LAST = 512


class _Index(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, x: str) -> int:
        n = self[x] = len(self)
        return n


class Remembered:
    """Numbers of strings, and what was made of each: an array. make: from some strings the arrays, end to end, and their sizes."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type):
        self.make, self.dtype = make, dtype
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.store, self.begin, self.size, self.used = np.zeros(1 << 12, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def numbers(self, rows: list[list[str]]) -> np.ndarray:
        """The number of each string, row after row; new ones are made first."""
        known = len(self.index)
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        for at in _runs(list(islice(self.index, known, None))):
            made, size = self.make(at)
            need = self.used + len(made)
            if need > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(need, len(self.store)), self.dtype)])
            self.store[self.used : need] = made
            self.begin, self.size = np.concatenate([self.begin, self.used + np.cumsum(size) - size]), np.concatenate([self.size, size])
            self.used = need
        return which

    def arrays(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers, end to end, and len + 1 bounds."""
        size = self.size[which]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.store[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[which], size)], total


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and their sizes."""
    return np.concatenate(arrays), np.array([len(x) for x in arrays], np.int64)


def _runs(strings: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in strings:
        part.append(x)
        size += len(x)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, those from U+0100 on for the others, in
    order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe:
    """A byte-level vocabulary with merges, as files of the tokenizers library have it. Its normaliser and pre-tokeniser are the library's; what they
    make is bounded by a word, the merging is done here."""

    def __init__(self, model: dict, normalizer=None, pre_tokenizer=None, special: dict[str, int] | None = None, cut: str = "", joined: bool = False):
        """model: vocab, merges, end_of_word_suffix. special: strings that stand for a token wherever they are in a text. cut: a pattern of parts of a
        text that nothing crosses ('': a text is one part). joined: tokens decode to bytes, else to their names with blanks between."""
        self.normalizer, self.pre_tokenizer, self.special, self.joined = normalizer, pre_tokenizer, dict(special or {}), joined
        self.cut, self.apart_by_blanks = re.compile(cut) if cut else None, cut == WORDS
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.names = [""] * size
        for name, k in (vocab | self.special).items():
            self.names[k] = name
        letters = byte_letters()
        #: Token of each code; -1: none.
        self.atoms = np.full(2 * LAST, -1)
        for c in letters:
            for code, name in ((ord(c), c), (ord(c) + LAST, c + self.suffix)):
                self.atoms[code] = vocab.get(name, -1)
        if (self.atoms[[ord(c) + (LAST if self.suffix else 0) for c in letters]] < 0).any() or (self.atoms[[ord(c) for c in letters]] < 0).any():
            raise ValueError("a byte without a token")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = size
        #: The rank of the merge that made a token (-1: none did), and its two parts.
        self.made, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.made[self.product], self.left[self.product], self.right[self.product] = np.arange(len(pairs)), left, right
        ranks = np.arange(len(pairs))
        if len(np.unique(self.product)) < len(pairs) or (np.maximum(self.made[left], self.made[right]) >= ranks).any():
            raise ValueError("merges that are out of order, or make a token twice, can't be verified by pairs")
        self.key = hash((tuple(self.names), tuple(pairs), tuple(self.special), cut))
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        whole = np.ones(size, bool)
        whole[self.product] = ~self.crossed(left, right, ranks)
        parts_whole = whole.copy()
        for m, a, b in zip(self.product.tolist(), left.tolist(), right.tolist(), strict=True):  # in order of rank, so parts come first
            parts_whole[m] &= bool(parts_whole[a] and parts_whole[b])
        self._trie(np.unique(np.concatenate([self.atoms[self.atoms >= 0], self.product[parts_whole[self.product]]])))

    @classmethod
    def load(cls, path: str, special: bool = True) -> Bpe:
        """A file of the tokenizers library. special: whether strings of special tokens in a text stand for these tokens."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        if model["type"] != "BPE" or kinds[-1] != "ByteLevel" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError(f"{path} isn't a byte-level vocabulary with plain merges")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("special tokens that take blanks along, or are looked for after normalising")
        decoder = spec.get("decoder")
        if (decoder or {"type": "ByteLevel"})["type"] != "ByteLevel":
            raise ValueError("a decoder other than ByteLevel")
        # Words hold no blanks where the pattern removes them; else a blank is at a word's start, or among blanks.
        normal = spec.get("normalizer") or {}
        known = {n["type"] for n in normal.get("normalizers", [normal] if normal else [])} <= {"NFC", "Lowercase", "Replace"}
        split = pre.get("pretokenizers", [{}])[0]
        if known and split.get("behavior") == "Removed" and r"\s" in str(split.get("pattern")):
            cut = WORDS
        elif not normal and kinds == ["ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space"):
            cut = f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+"
        else:
            cut = ""
        library = Tokenizer.from_file(path)
        added = {a["content"]: a["id"] for a in spec["added_tokens"]} if special else {}
        made = cls(model, library.normalizer, library.pre_tokenizer, added, cut, decoder is not None)
        for a in spec["added_tokens"]:  # they decode even where texts can't name them
            made.names += [""] * (a["id"] + 1 - len(made.names))
            made.names[a["id"]] = a["content"]
        return made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of two tokens; NEVER where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def crossed(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the texts of two tokens, one after the other, joins an end of the left one with a start of the right one (by a merge whose
        rank is less than `before`).

        Merges run in order of rank. So it goes back in time, undoing the later one of the two merges that made what meets at the border (of equal
        ones the right one, as the left one came first), and at each time looks whether the two would have merged before either went on.
        """
        out = np.zeros(len(left), bool)
        live, l, r = np.arange(len(left)), left, right
        until = np.full(len(left), NEVER) if before is None else before
        end_l, end_r = until, until
        while len(live):
            rank = self.rank(l, r)
            hit = (rank < end_l) & (rank <= end_r) & (rank < until[live])
            out[live[hit]] = True
            made_l, made_r = self.made[l], self.made[r]
            on = ~hit & ((made_l >= 0) | (made_r >= 0))
            live, l, r, end_l, end_r, made_l, made_r = (x[on] for x in (live, l, r, end_l, end_r, made_l, made_r))
            back = made_r >= made_l
            end_l, end_r = np.where(back, end_l, made_l), np.where(back, made_r, end_r)
            l, r = np.where(back, l, self.right[l]), np.where(back, self.left[r], r)
        return out

    def codes(self, name: str) -> list[int]:
        """The codes of a token's characters."""
        if self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix):
            body = [ord(c) for c in name[: -len(self.suffix)]]
            return [*body[:-1], body[-1] + LAST]
        return [ord(c) for c in name]

    def _trie(self, tokens: np.ndarray) -> None:
        """Steps (node, code) to node, sorted; and the token that ends at each node."""
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for k in tokens.tolist():
            node = 0
            for code in self.codes(self.names[k]):
                node = steps.setdefault((node, code), len(steps) + 1)
            ends[node] = k
        keys = np.array([node << 11 | code for node, code in steps], np.int64)
        order = np.argsort(keys)
        self.step_keys, self.step_to = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.ends = np.full(len(steps) + 1, -1)
        self.ends[list(ends)] = list(ends.values())

    def longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the longest token that starts there, and its length (-1 and 0: none does)."""
        token, size = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            key = node << 11 | codes[at + depth]
            step = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            there = self.step_keys[step] == key
            at, node, depth = at[there], self.step_to[step[there]], depth + 1
            ends = self.ends[node] >= 0
            token[at[ends]], size[at[ends]] = self.ends[node[ends]], depth
            inside = at + depth < len(codes)
            at, node = at[inside], node[inside]
        return token, size

    def merged(self, atoms: list[int]) -> list[int]:
        """The merges one by one: always the pair of least rank, of equals the leftmost."""
        if not hasattr(self, "_ranks"):
            self._ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
            self._product = self.product.tolist()
        return self._short(atoms) if len(atoms) <= SHORT else self._long(atoms)

    def _short(self, tokens: list[int]) -> list[int]:
        get, size, product = self._ranks.get, self.size, self._product
        ranks = [get(a * size + b, NEVER) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks and (rank := min(ranks)) < NEVER:
            i = ranks.index(rank)
            tokens[i : i + 2] = [product[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(tokens[i - 1] * size + tokens[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(tokens[i] * size + tokens[i + 1], NEVER)
        return tokens

    def _long(self, atoms: list[int]) -> list[int]:
        ranks, size, n, tokens = self._ranks, self.size, len(atoms), list(atoms)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[k], i) for i in range(n - 1) if (k := tokens[i] * size + tokens[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or ranks.get(tokens[i] * size + tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = self._product[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := tokens[a] * size + tokens[b]) in ranks:
                    heapq.heappush(heap, (ranks[k], a))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in byte-level characters, end to end, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size + 1)])  # an end of line after each word is in no token
        if self.suffix:
            codes[bounds[1:][size > 0] - 2] += LAST
        token, length = self.longest(codes)
        hops, at, n = [], 0, len(codes)
        jump = np.maximum(length, 1).tolist()
        while at < n:
            hops.append(at)
            at += jump[at]
        hops = np.array(hops, np.int64)
        hops = hops[token[hops] >= 0]
        ids, word = token[hops], np.searchsorted(bounds, hops, "right") - 1
        same = word[1:] == word[:-1]
        pairs, inverse = np.unique(ids[:-1][same] * self.size + ids[1:][same], return_inverse=True)
        wrong = self.crossed(pairs // self.size, pairs % self.size)[inverse] if len(pairs) else np.zeros(0, bool)
        again = np.unique(word[1:][same][wrong])
        bad = np.zeros(len(words), bool)
        bad[again] = True
        atoms = self.atoms[codes].tolist()
        merged = [self.merged(atoms[a:b]) for a, b in zip(bounds[again].tolist(), (bounds[again + 1] - 1).tolist(), strict=True)]
        sizes = np.bincount(word, minlength=len(words))
        sizes[again] = [len(m) for m in merged]
        out = np.zeros(sizes.sum(), np.int32)
        of_bad = np.repeat(bad, sizes)
        out[of_bad], out[~of_bad] = list(chain.from_iterable(merged)), ids[~bad[word]]
        return out, sizes

    def _words(self, part: str) -> list[str | int]:
        """The words of a part of a text, in byte-level characters; a special token is its id."""
        out: list[str | int] = []
        for x in self.apart.split(part) if self.apart else (part,):
            if x in self.special:
                out.append(self.special[x])
            elif x:
                normal = self.normalizer.normalize_str(x) if self.normalizer else x
                out += [w for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)] if normal else []
        return out

    def _rows(self, parts: list[str]) -> list[list[str | int]]:
        """The words of each part; all at once where blanks part them and none are kept."""
        if not self.apart_by_blanks or any(x in p for p in parts for x in self.special):
            return [self._words(p) for p in parts]
        normal = self.normalizer.normalize_str(" ".join(parts)) if self.normalizer else " ".join(parts)
        made = self.pre_tokenizer.pre_tokenize_str(normal)
        sizes = [len(p) for p in normal.split(" ")]
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        at = np.searchsorted(np.fromiter((span[0] for _, span in made), np.int64, len(made)), starts)
        words = [w for w, _ in made]
        return [words[i:j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def encoder(self) -> Remembered:
        """Encodes parts that nothing crosses; it remembers them, and their words."""
        known = Remembered(self.encode_words, np.int32)

        def make(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(known.index) > REMEMBERED:
                known.clear()
            rows = self._rows(parts)
            named = self.special and any(not isinstance(w, str) for row in rows for w in row)
            ids, ends = known.arrays(known.numbers([[w for w in row if isinstance(w, str)] for row in rows] if named else rows))
            if not named:
                return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])])])
            out, k = [], 0
            for row in rows:
                own = [np.zeros(0, np.int32)]
                for w in row:
                    own.append(ids[ends[k] : ends[k + 1]] if isinstance(w, str) else np.array([w], np.int32))
                    k += isinstance(w, str)
                out.append(np.concatenate(own))
            return joined(out)

        return Remembered(make, np.int32)

    def parts(self, text: str | None) -> list[str]:
        return ([text] if self.cut is None else self.cut.findall(text)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The library's text of these ids. Ids outside the vocabulary, and nulls, are left out."""
        n = len(self.names)
        return self.text([k for k in ids if k is not None and 0 <= k < n])

    def text(self, ids: list[int]) -> str:
        """decode() of ids in the vocabulary."""
        names = map(self.names.__getitem__, ids)
        return b"".join(map(self.token_bytes, names)).decode("utf-8", "replace") if self.joined else " ".join(names)

    @staticmethod
    def token_bytes(name: str) -> bytes:
        """The bytes of a byte-level name; one with other characters (a special token) stands for its own text."""
        return bytes([_BYTES[c] for c in name]) if all(c in _BYTES for c in name) else name.encode()


_BYTES = byte_letters()


def encode(docs: DataFrame, bpe: Bpe, column: str = "text", ids: bool = True, packed: bool = False, decoded: bool = False) -> DataFrame:
    """The columns of docs and, of the text in that column, those asked for: _ids (array), _packed (the ids as unsigned 32-bit numbers, least byte
    first) and _decoded (the text that the ids decode to).

    Ids are those of the tokenizers library without its special tokens around a text. A null or empty text, or one of blanks alone where the model
    drops blanks, has no ids, an empty _packed and an empty _decoded. Repeated rows are encoded one by one; columns of docs with these names are
    replaced, others pass through. A text is read in parts that nothing crosses, and each distinct part is encoded once a task.
    """
    added = {"_ids": ("array<int>", ids), "_packed": ("binary", packed), "_decoded": ("string", decoded)}
    names = [c for c in docs.columns if c not in added]
    wanted = [c for c, (_, on) in added.items() if on]
    docs = docs.select(*names)
    schema = docs.select("*", *[F.lit(None).cast(added[c][0]).alias(c) for c in wanted]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bpe.encoder()
        for held in slices(batches, column):
            if len(known.index) > REMEMBERED:
                known.clear()
            rows = [bpe.parts(t) for t in held.column(column).to_pylist()]
            every, ends = known.arrays(known.numbers(rows))
            bounds = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])])]
            made = {}
            if ids:
                made["_ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(every))
            if packed:
                raw = np.ascontiguousarray(every, "<u4").tobytes()
                made["_packed"] = pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
            if decoded:
                flat = every.tolist()
                made["_decoded"] = pa.array([bpe.text(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*held.columns, *[made[c] for c in wanted]], [*names, *wanted])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, bpe: Bpe, column: str = "_ids", to: str = "text") -> DataFrame:
    """The columns of docs and the text of its ids. A null list has a null text, an empty one an empty text; ids outside the vocabulary, and nulls, are
    left out."""
    names = [c for c in docs.columns if c != to]
    docs = docs.select(*names)
    schema = docs.select("*", F.lit(None).cast("string").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [None if row is None else bpe.decode(row) for row in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, to])

    return docs.mapInArrow(run, schema)
