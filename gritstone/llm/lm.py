"""LM scoring: corpus counts by shuffle, a gated recurrent model trained on shards of the corpus and averaged, round after round, and
log-probabilities of whole documents.

Training documents are dealt to shards by a hash of their text. A round trains on twice as many shards as the one before, each from the
mean of the round before it, so the rounds grow with the logarithm of the corpus and the model with all of it; and a shard's documents and their order
follow from the texts
alone, so the model does too.

Words are 64-bit hashes. The most frequent ones are the network's vocabulary; all others share MEMBERS tail tokens by their last two bytes, and a
tail word's probability is that of its tail token times its add-one share among the tail words of that token, over all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gru import MEMBERS, VOCABULARY, Model, Trainer, score_documents, train_on
from .shared import LOWER, SPACE, drop, hash_words, mix, save, signed, slices, text_bytes

#: At most so many frequent words' counts go to every task (16 bytes each, 4 MB); the counts of the others are joined.
HEAD = 1 << 18
#: Tokens that are trained or scored on at a time, and tokens of a shard.
CHUNK, SHARD_TOKENS = 1 << 20, 1 << 20
#: Blocks of parameters, for averaging.
BLOCK = 1 << 13
#: Stands for the end of a document; no word's hash is looked for here but by a chance of 2**-64.
END = np.uint64(0x5EED0FE17D0C5EED)
_SUFFIX = mix(np.arange(1, 1 << 16 | 1, dtype=np.uint64)) % np.uint64(MEMBERS)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with END after each text, their tail tokens (0 to MEMBERS - 1), and bounds."""
    words, at = hash_words(texts)
    raw, _ = text_bytes(texts)
    tails = _tail_of(raw, texts, words)
    n = len(texts)
    out = np.empty(len(words) + n, np.uint64)
    kind = np.zeros(len(out), np.int64)
    ends = at[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    kind[is_word] = tails
    return out, kind, np.concatenate([[0], ends + 1])


def _tail_of(raw: np.ndarray, texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """The tail token of each word, from its last two bytes (one, for a word of one)."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, bounds = text_bytes(texts)
    low = LOWER[raw].astype(np.int64)
    space = SPACE[raw]
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = space[1:]
    cut = bounds[1:] - 1
    last[cut[cut >= 0]] = True
    ends = np.flatnonzero(last & ~space)
    before = np.where(ends > 0, low[ends - 1], 0)
    opens = np.zeros(len(raw) + 1, bool)
    opens[bounds[:-1]] = True
    alone = opens[ends] | (ends == 0) | space[ends - 1]
    return _SUFFIX[low[ends] << 8 | np.where(alone, 0, before)].astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, tail and c over all docs: each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tails, n = [], [], 0

        def emit() -> pa.RecordBatch:
            every, kind = np.concatenate(words), np.concatenate(tails)
            word, first, c = np.unique(every, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([signed(word), pa.array(kind[first].astype(np.int32)), pa.array(c)], ["word", "tail", "c"])

        for batch in slices(batches):
            w, k, _ = _tokens(batch.column("text"))
            words.append(w)
            tails.append(k)
            n += len(w)
            if n >= 4 * CHUNK:
                yield emit()
                words, tails, n = [], [], 0
        if n:
            yield emit()

    return save(docs.select("text").mapInArrow(count, "word bigint, tail int, c bigint").groupBy("word", "tail").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Head:
    """The frequent words in order of hash, their counts and network tokens (-1: none of their own); and the sums over all training words."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    first: int
    n: int
    v: int
    tail_n: np.ndarray
    tail_v: np.ndarray
    token_counts: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Head:
        bin_ = F.floor(F.log2("c") * 16)
        bins = sorted(counts.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect(), reverse=True)  # at most 1008 rows
        n, v = sum(r.n for r in bins), sum(r.v for r in bins)
        least, held = None, 0
        for r in bins:
            held += r.v
            if held > HEAD:
                break
            least = r.b
        if least is None:
            table = pa.table({"word": pa.array([], pa.int64()), "tail": pa.array([], pa.int32()), "c": pa.array([], pa.int64())})
        else:
            table = counts.where(bin_ >= least).select("word", "tail", "c").toArrow()  # at most HEAD rows
        words, c, tail = table["word"].to_numpy().view(np.uint64), table["c"].to_numpy(), table["tail"].to_numpy()
        order = np.argsort(words)
        words, c, tail = words[order], c[order], tail[order]
        by_count = np.lexsort((words, -c))
        own = by_count[: VOCABULARY - MEMBERS]
        ids = np.full(len(words), -1)
        ids[own] = np.arange(len(own))
        end = np.searchsorted(words, END)
        if end < len(words) and words[end] == END and ids[end] < 0:  # the end always has a token of its own
            ids[own[-1]], ids[end] = -1, ids[own[-1]]
        first = int(ids[end]) if end < len(words) and words[end] == END else 0
        tails = {r.tail: r for r in counts.groupBy("tail").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()}
        tail_n = np.array([tails[k].n if k in tails else 0 for k in range(MEMBERS)], float)
        tail_v = np.array([tails[k].v if k in tails else 0 for k in range(MEMBERS)], float)
        mine = ids >= 0
        np.subtract.at(tail_n, tail[mine], c[mine])
        np.subtract.at(tail_v, tail[mine], 1)
        token_counts = np.zeros(VOCABULARY)
        token_counts[ids[mine]] = c[mine]
        token_counts[VOCABULARY - MEMBERS :] = tail_n
        return cls(words, c, ids, first, int(n), int(v), tail_n, tail_v, token_counts)

    def look_up(self, words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network tokens and counts; count -1 where the word is no frequent one."""
        if not len(self.words):
            return VOCABULARY - MEMBERS + tails, np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        there = self.words[at] == words
        ids = np.where(there, self.ids[at], -1)
        return np.where(ids >= 0, ids, VOCABULARY - MEMBERS + tails), np.where(there, self.counts[at], -1)


def _marked(docs: DataFrame, head: Head) -> DataFrame:
    """From docs (doc_id, text, training, key): row, doc_id, training, key, n_tokens, known, base and inner (the log10 shares that frequent words have
    of the base and of their tail tokens), ids (the network's tokens, two bytes each), and the words and tails that aren't frequent."""
    whole = float(head.n + head.v + 1)
    names = ["row", "doc_id", "training", "key", "n_tokens", "known", "base", "inner", "ids", "words", "tails"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId() << 36, 0
        for batch in slices(batches):
            words, tails, bounds = _tokens(batch.column("text"))
            ids, c = head.look_up(words, tails)
            frequent, own = c >= 0, ids < VOCABULARY - MEMBERS
            base = np.where(frequent, np.log10((np.maximum(c, 0) + 1) / whole), 0)
            inner = np.where(frequent & ~own, np.log10((np.maximum(c, 0) + 1) / (head.tail_n[tails] + head.tail_v[tails] + 1)), 0)
            per = lambda v: pa.array(np.add.reduceat(v, bounds[:-1]))  # noqa: E731, B023  no document is without a token
            rest = np.flatnonzero(~frequent)
            cuts = pa.array(np.searchsorted(rest, bounds).astype(np.int32))
            n = len(bounds) - 1
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([
                pa.array(part + at + np.arange(n)), *(batch.column(c) for c in names[1:4]), pa.array(np.diff(bounds)), per((c > 0).astype(np.int64)), per(base), per(inner), packed,
                pa.ListArray.from_arrays(cuts, signed(words[rest])), pa.ListArray.from_arrays(cuts, pa.array(tails[rest].astype(np.int32))),
            ], names)
            at += n

    schema = "row bigint, doc_id bigint, training boolean, key bigint, n_tokens bigint, known bigint, base double, inner double, ids binary, words array<bigint>, tails array<int>"
    return save(docs.mapInArrow(look, schema), "tokens")


def _laid_out(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end, and bounds."""
    return np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def train(tokens: DataFrame, head: Head, lanes: int = 512, steps: int = 12) -> Model:
    """tokens: training, key and ids of documents. The mean of a round's models is weighted by their tokens; sums are made by block of parameters and
    in order of shards, so only one model reaches the driver, and always the same."""
    start = Model.start(head.token_counts)
    size = len(start.flat())
    state = np.concatenate([start.flat(), np.full(size, 1e-3, np.float32)])
    shards = max(1, -(-head.n // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    lessons = save(
        tokens.where("training").select(
            F.floor(F.log2(shard + 1)).cast("int").alias("round"), shard.alias("shard"), "key", "ids"
        ).repartition("round", "shard"),
        "lessons"
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From documents in order of shards."""
        last, trainer, held, waiting, n = None, None, [], 0, 0

        def learn() -> None:
            ids, bounds = _laid_out(held)
            starts = np.zeros(len(ids), bool)
            starts[bounds[:-1]] = True
            train_on(trainer, ids, starts, head.first, lanes, steps)

        def made() -> pa.RecordBatch:
            if held:
                learn()
            flat = trainer.flat()
            blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            every = lambda v, kind: pa.array(np.full(len(blocks), v), kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(blocks), dtype=np.int32)), every(last % 64, pa.int32()), every(last, pa.int64()), every(n, pa.int64()),
                    pa.array(blocks, pa.binary())
                ],
                ["block", "salt", "shard", "n", "v"]
            )

        for batch in batches:
            for own, packed in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if own != last:
                    if last is not None:
                        yield made()
                    last, trainer, held, waiting, n = own, Trainer(Model.of(state[:size]), seen=state[size:]), [], 0, 0
                held.append(np.frombuffer(packed.as_buffer(), np.uint16))
                waiting, n = waiting + len(held[-1]), n + len(held[-1])
                if waiting >= CHUNK:
                    learn()
                    held, waiting = [], 0
        if last is not None:
            yield made()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Means by block and salt, of rows in order."""
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, salt, n, v in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "n", "v")), strict=True):
                x = np.frombuffer(v, np.float32)
                held = sums.setdefault((block, salt), [0, np.zeros(len(x))])
                held[0] += n
                held[1] += x.astype(float) * n
        means = [(s[1] / max(1, s[0])).astype(np.float32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in sums], pa.int32()), pa.array([x for _, x in sums], pa.int32()),
                pa.array([s[0] for s in sums.values()], pa.int64()), pa.array(means, pa.binary())
            ],
            ["block", "salt", "n", "v"]
        )

    means = "block int, salt int, n bigint, v binary"
    for turn in range(int(shards).bit_length()):
        dealt = lessons.where(F.col("round") == turn).select("shard", "key", "ids").repartition(
            min(1 << turn, shards), "shard"
        ).sortWithinPartitions("shard", "key")
        models = dealt.mapInArrow(
            fit, "block int, salt int, shard bigint, n bigint, v binary"
        ).repartition("block", "salt").sortWithinPartitions("block", "salt", "shard")
        few = models.mapInArrow(total, means).withColumn("part", F.col("salt")).withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block", "part")
        rows = sorted(few.select("block", "salt", "n", "v").mapInArrow(total, means).collect())  # one model
        if rows:
            state = np.concatenate([np.frombuffer(r.v, np.float32) for r in rows])
    drop(lessons)
    return Model.of(state[:size])


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text), learning from the rows that training holds for.

    A null or empty text is the end alone. base_score is the add-one unigram model's log10 probability, score the recurrent
    model's. Repeated rows are scored one by one; a null doc_id is a value like any other. With no training documents every
    token is unknown: the base is then log10(1 / 1) a token, and the network is the uniform start.
    Other columns are not looked at.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("training"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    )
    counts = word_counts(docs.where("training"))
    head = Head.of(counts)
    tokens = _marked(docs, head)
    model = train(tokens, head)
    log10e = np.log10(np.e)
    names = ["row", "doc_id", "n_tokens", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 2 * CHUNK):
            ids, bounds = _laid_out([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("ids")])
            net = score_documents(model, ids, bounds, head.first) * log10e + batch.column("inner").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(net)], names)

    scored = tokens.select("row", "doc_id", "n_tokens", "known", "base", "inner", "ids").mapInArrow(
        run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double"
    )
    # What is not frequent: the words of a document with their counts, joined by word.
    rest = tokens.select("row", F.explode(F.arrays_zip("words", "tails")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.tails").alias("tail")
    )
    table = F.array(*[F.lit(float(a + b + 1)) for a, b in zip(head.tail_n, head.tail_v, strict=True)])
    whole, c = F.lit(float(head.n + head.v + 1)), F.coalesce("c", F.lit(0))
    joined = rest.join(counts.select("word", "c"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(c > 0, 1).otherwise(0)).alias("more"), F.sum(F.log10((c + 1) / whole)).alias("more_base"),
        F.sum(F.log10((c + 1) / F.element_at(table, F.col("tail") + 1))).alias("more_score")
    )
    zero = lambda name, to: F.coalesce(name, F.lit(to))
    out = scored.join(sums, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + zero("more", 0)).alias("n_known"), F.lit(head.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("more_base", 0.0)).alias("base_score"), (F.col("score") + zero("more_score", 0.0)).alias("score")
    )
