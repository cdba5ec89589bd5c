"""N-gram Jaccard join: adaptive multi-match prefixes over sets of word shingles, and the groups that its links make.

A document is the set of its distinct word shingles, each a 64-bit hash. Documents with equal sets are one node, named by a hash of
the set. In a fixed order of shingles, rare before frequent, a node of n shingles that must share at least a = ceil(t n) with any partner shares
at least l tokens between its prefix of n - a + l and the partner's. Each node picks its own l: more prefix tokens
cost more rows, but where its tokens are frequent a pair must then share more of them before it is verified. A pair is
verified when it shares the smaller of its two l, which loses no pair, as the longer prefix holds the shorter. Three facts of a pair that must share o
shingles cut down what is looked at. The smaller of the two needs only a prefix of n - ceil(2 t n / (1 + t)) + l, as o is at least that ceiling. A
shared token at places i
and j leaves at most min(i, j) before it and the shorter rest after it. What the two share outside both prefixes lies in the rest of the
one whose prefix ends first, so they share o less the larger rest within the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bits_of, drop, hash_words, id_bits, in_bits, mix, save, shingles, signed, slices, with_slot

#: Slots of the table of shingle counts, which every task holds: 2 MB whatever the corpus.
LOG_SLOTS = 18
#: Prefix tokens beyond the shortest prefix that a document may choose.
CHOICES = (1, 2, 3, 4, 6, 8)
#: Cost of verifying a candidate, in prefix tokens.
VERIFY_COST = 2.0
#: Bits of the filter of tokens that two or more nodes hold: 4 MB whatever the corpus. Where it fills up, it merely lets more rows through to the
#: join.
TOKEN_BITS = 25
#: Rounds that try each node against the most central holder of its tokens, before the rest is joined in full.
STAR_ROUNDS = 1


def _sets(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingles of each text, and the hash of each set."""
    s, bounds = shingles(*hash_words(batch.column("text")), size)
    out, names = [], np.zeros(len(batch), np.uint64)
    for d in range(len(batch)):
        x = np.sort(s[bounds[d] : bounds[d + 1]])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        out.append(x)
        names[d] = mix(x + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) if len(x) else 0
    return out, mix(names ^ np.array([len(x) for x in out], np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """One look at every text: rows (kind 0) of doc_id, n and node, and rows (kind 1) of slot and count for the shingle counts of each task."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LOG_SLOTS, np.int64)
        names = ["kind", "id", "n", "node"]
        for batch in slices(batches):
            sets, nodes = _sets(batch, size)
            if sets:
                every = np.concatenate(sets)
                counts += np.bincount((every >> np.uint64(64 - LOG_SLOTS)).astype(np.int64), minlength=1 << LOG_SLOTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(batch), np.int32)), batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), signed(nodes)], names
            )
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(held), np.int32)), pa.array(held), pa.array(counts[held]), pa.array(held)], names)

    return save(docs.mapInArrow(look, "kind int, id bigint, n bigint, node bigint"), "survey")


def _excess(survey: DataFrame) -> np.ndarray:
    """How often a slot's shingles are seen beyond what chance puts into any slot; 0 within the noise."""
    counts = np.zeros(1 << LOG_SLOTS)
    for r in survey.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a row a slot
        counts[r.id] = r.n
    usual = np.median(counts)
    return np.where(counts > usual + 6 * np.sqrt(usual + 1) + 2, counts - usual, 0)


def choose_prefix(excess: np.ndarray, percent: int) -> tuple[int, int]:
    """(length, l) of least estimated cost. excess: the estimated number of other holders of each token, in prefix order.

    Each holder of a token of the shorter prefix costs a row, and at most a share 1/l of these rows are documents that share l tokens, to be verified.
    """
    n = len(excess)
    must, must_small = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    total = np.concatenate([[0.0], np.cumsum(excess)])
    cost = {m: (n - must + m) + (1 + VERIFY_COST / m) * total[n - must_small + m] for m in CHOICES if m <= must}
    best = min(cost, key=cost.get)
    return n - must + best, best


def _postings(docs: DataFrame, size: int, percent: int, excess: np.ndarray, bits: np.ndarray | None = None) -> DataFrame:
    """token, node and, in places and meta, n, pos, central and l for each prefix token of each node whose bit is set; a task gives a node once,
    however many copies it sees."""
    levels = np.ceil(np.log2(excess + 1)).astype(np.uint64)
    names = ["token", "node", "places", "meta"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets, nodes = _sets(batch, size)
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
            for x, node in zip(sets, nodes.tolist(), strict=True):
                if not len(x) or node in seen:
                    continue
                seen.add(node)
                slot = (x >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)
                level, held = levels[slot], excess[slot]
                if level.any():
                    order = np.lexsort((x, level))
                    x, held = x[order], held[order]
                length, m = choose_prefix(held, percent)
                at = np.arange(length)
                if bits is not None:
                    at = at[in_bits(bits, x[:length] & np.uint64((1 << TOKEN_BITS) - 1))]
                for column, values in zip(
                    columns,
                    (
                        x[at], np.full(len(at), node, np.uint64), len(x) << 32 | at,
                        np.full(len(at), min(int(level.mean() * 200), 0xFFF) << 4 | m, np.int32)
                    ),
                    strict=True
                ):
                    column.append(values)
            token, node, places, meta = map(np.concatenate, columns)
            yield pa.RecordBatch.from_arrays([signed(token), signed(node), pa.array(places), pa.array(meta)], names)

    return docs.mapInArrow(emit, "token bigint, node bigint, places bigint, meta int")


def _shared_postings(docs: DataFrame, size: int, percent: int, excess: np.ndarray) -> DataFrame:
    """The postings of tokens that two or more nodes hold.

    Which these are is counted within tasks before the shuffle; then only their postings are shuffled, to a join with the table of these tokens, of
    which adaptive execution can split any token.
    """
    held = _postings(docs, size, percent, excess).groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = save(held.where("low <> high").select("token"), "tokens")
    bits = bits_of(shared.select(F.col("token").bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)).alias("s")), TOKEN_BITS)
    rows = _postings(docs, size, percent, excess, bits).join(shared, "token")
    found = save(
        rows.select(
            "token", "node",
            *[
                F.expr(f"cast({e} as int)").alias(c) for c,
                e in (("n", "places >> 32"), ("pos", "places & 4294967295"), ("central", "meta >> 4"), ("l", "meta & 15"))
            ]
        ).dropDuplicates(["token", "node"]),
        "postings"
    )
    drop(shared)
    return found


def _held_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its set as bytes for the wanted (node, rep). Texts of other documents stay where they are: a fixed-size filter of the representatives'
    ids goes to the tasks, and the join settles the rest."""
    bits = id_bits(wanted, "rep")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bits(bits, batch.column("_slot").to_numpy(zero_copy_only=False))))
            for part in slices(iter([batch])):
                sets, nodes = _sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), signed(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "node", "shingles"]
                )

    held = with_slot(docs, "doc_id").mapInArrow(emit, "rep bigint, node bigint, shingles binary")
    return save(held.join(wanted, ["rep", "node"], "left_semi").dropDuplicates(["rep", "node"]).select("node", "shingles"), "sets")


def _ceiling(n: str, over: str, percent: int) -> str:
    """The least number of shingles that a node must share with a larger partner (over 'small') or any."""
    return f"(({2 * percent} * {n} + {99 + percent}) div {100 + percent})" if over == "small" else f"(({percent} * {n} + 99) div 100)"


def _need(percent: int) -> str:
    return f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"


def _may_link(percent: int) -> str:
    """Whether the rows of two nodes, a and b, for one token may be part of a link."""
    sizes = f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}"
    small = lambda x: f"pos_{x} < n_{x} - {_ceiling(f'n_{x}', 'small', percent)} + l_{x}"
    places = f"least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b) >= {_need(percent)}"
    return f"{sizes} and (n_a > n_b or {small('a')}) and (n_b > n_a or {small('b')}) and {places}"


def _enough(percent: int) -> str:
    """Whether a pair may be linked that shares `shared` of its prefix tokens."""
    rest = lambda x, y: f"if(n_{x} <= n_{y}, {_ceiling(f'n_{x}', 'small', percent)}, {_ceiling(f'n_{x}', 'any', percent)}) - l_{x}"
    return f"shared >= least(l_a, l_b) and shared >= {_need(percent)} - greatest({rest('a', 'b')}, {rest('b', 'a')})"


def _open(postings: DataFrame, labels: DataFrame, *more) -> tuple[DataFrame, DataFrame]:
    """The postings, with their nodes' components, of tokens that nodes of different components hold, and the table of these tokens with what `more`
    adds up. A token's sums are made within tasks first, and joined to its rows as a table of their own."""
    rows = postings.join(labels, "node")
    sums = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *more).where("low <> high").drop("low", "high")
    sums = save(sums, "open-tokens")
    return rows.join(sums, "token"), sums


def _star(postings: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """a, b: each node with the one it shares most of those tokens with whose most central holder is that one; and a table to drop. A guess at what
    falls together; nothing rests on it."""
    fields = ("node", "n", "pos", "l", "component")
    rows, sums = _open(postings, labels, F.max(F.struct("central", *fields)).alias("top"))
    rows = rows.select(*[F.col(c).alias(f"{c}_a") for c in fields], *[F.col(f"top.{c}").alias(f"{c}_b") for c in fields])
    pairs = rows.where(
        "node_a <> node_b and component_a <> component_b"
    ).where(_may_link(percent)).groupBy("node_a", "n_a", "l_a", "node_b", "n_b", "l_b").agg(F.count(F.lit(1)).alias("shared")).where(_enough(percent))
    best = F.row_number().over(Window.partitionBy("node_a").orderBy(F.desc("shared"), "node_b"))
    return pairs.withColumn("best", best).where("best = 1").select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    ).distinct(), sums


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """a, b: every pair of nodes of different components that may be linked."""
    x, y = (postings.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "l", "component")]) for s in "ab")
    pairs = x.join(y, "token").where("node_a < node_b and component_a <> component_b").where(_may_link(percent))
    pairs = pairs.groupBy("node_a", "n_a", "l_a", "node_b", "n_b", "l_b").agg(F.count(F.lit(1)).alias("shared")).where(_enough(percent))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b and linked for each pair."""
    both = pairs.select("a", "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"
    ).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "x"), "y"):
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                together = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((together[1:] == together[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return save(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, linked boolean"), "verified")


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text): components of the links 100 |A and B| >= percent |A or B|.

    A text of fewer than `size` words is one shingle, its whole sequence; a null text or one without words has none, is linked
    with nothing and is its own component. Documents with equal sets are linked. Repeated rows each come back; rows with the
    same doc_id and different texts put both into one component. A null doc_id has a null component_id and links nothing. Other columns are not looked
    at.

    Tokens are counted first, within tasks before the shuffle, and then only the rows of tokens that two or more nodes hold are shuffled. A first
    round tries each node against the most central
    holder of its tokens, so that a group of thousands of near copies falls together over as many pairs as it has members;
    pairs that are still in different components are then joined in full, so no link between components is lost.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    survey = _survey(texts, size)
    rows = survey.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "node")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    reps = save(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "representatives")

    known = texts.where("doc_id is not null")
    postings = _shared_postings(known, size, percent, _excess(survey))
    nodes = save(postings.select("node").distinct().join(reps, "node").select("node", "rep"), "nodes")
    copied = reps.where("rep <> last").select("node", "rep")
    copies = named.join(copied, "node").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()  # a doc_id with two texts links their nodes

    links = tested = None
    scratch = [reps, postings, nodes]
    for k in range(STAR_ROUNDS + 1):
        labels = nodes.select("node", F.col("rep").alias("component"))
        if links is not None:
            groups = components(links)
            labels = nodes.join(groups, nodes.rep == groups.id, "left").select("node", F.coalesce("component", "rep").alias("component"))
            scratch.append(groups)
        if k < STAR_ROUNDS:
            pairs, sums = _star(postings, labels, percent)
        else:
            open_, sums = _open(postings, labels)
            open_ = save(open_, "open")
            pairs = _all_pairs(open_, percent)
            scratch.append(open_)
        pairs = save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        scratch += [sums, pairs]
        if pairs.isEmpty():
            continue
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node")
        wanted = save(wanted, "wanted")
        sets = _held_sets(known, wanted, size)
        found = _verified(pairs, sets, percent)
        drop(sets, wanted)
        scratch.append(found)
        tested = found.select("a", "b") if tested is None else tested.unionByName(found.select("a", "b"))
        fresh = found.where("linked").join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select("u", "v")
        links = save(fresh if links is None else links.unionByName(fresh), "links")
        scratch.append(links)
    groups = components(copies if links is None else copies.unionByName(links))
    drop(*scratch)
    groups = groups.select(F.col("id").alias("doc_id"), "component")
    return rows.join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the least of their group; of repeated rows with that doc_id, the one whose text has the
    least xxhash64. Texts without words and rows with a null doc_id all stay."""
    groups = jaccard_groups(docs, size, percent)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs.doc_id.cast("bigint") == gone["_gone"], "left_anti")
    names = docs.columns
    wordless = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$") | F.col("doc_id").isNull()
    again = F.lag(F.lit(1)).over(Window.partitionBy("doc_id", wordless).orderBy(F.xxhash64("text")))
    return left.withColumn("_again", again).where(F.col("_again").isNull() | wordless).select(*names)
