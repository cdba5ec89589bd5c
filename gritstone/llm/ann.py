"""Approximate nearest neighbours by learned partitions: a neighbour graph of a sample is cut into balanced parts, a small classifier learns the
parts, every
vector is indexed in its likeliest part, and a query is compared with all vectors of its few likeliest parts. Where there are more vectors than one
classifier's parts hold,
each part is cut again in the same way, by a sample and a classifier of its own, which are fitted in tasks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, save

#: Vectors that parts and classifier are fitted on, in all and in each part that is cut again, and neighbours of each in the graph.
SAMPLE, INNER_SAMPLE, NEIGHBOURS = 8192, 2048, 10
#: Vectors that a part should hold, and the most parts of the first cut and of each second one: classifiers, which go to every task, are bounded by
#: these.
PART_ROWS, MOST_PARTS, MOST_INNER = 1000, 256, 64
#: Recall on the sample's own queries that the number of parts to look into is chosen for.
WANTED = 0.98
#: About so many rows of a part, and so many queries of it, meet in a task, however many there are. A row goes out more than once only where a part
#: has more queries.
BLOCK_ROWS, TURN_ROWS = 4096, 1 << 15


def _near(x: np.ndarray, y: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Indices in y of the k nearest to each x; own: x is y, and no one is its own neighbour."""
    out = []
    squares = (y * y).sum(1)
    for a in range(0, len(x), 512):
        d = squares - 2 * (x[a : a + 512] @ y.T)
        if own:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        part = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for each node of the graph (neighbour lists): parts grow from the graph's walk order as equal runs; then nodes move, the gainful ones
    first, to the part that most of their neighbours are in, while it has room."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    sides = [list(row) for row in graph.tolist()]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            sides[b].append(a)
    order, seen = [], np.zeros(n, bool)
    for root in rng.permutation(n).tolist():  # breadth first, so that a run of the order is connected
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        for v in queue:
            for w in sides[v]:
                if not seen[w]:
                    seen[w] = True
                    queue.append(w)
        order += queue
    part = np.empty(n, np.int64)
    part[order] = np.arange(n) * parts // n
    room = int(np.ceil(slack * n / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moves = []
        for v in range(n):
            near = np.bincount(part[sides[v]], minlength=parts)
            best = int(near.argmax())
            if near[best] > near[part[v]]:
                moves.append((near[best] - near[part[v]], v, best))
        moved = 0
        for _, v, to in sorted(moves, key=lambda m: -m[0]):
            if size[to] < room:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer; probes: the parts to look into."""

    mean: np.ndarray
    scale: float
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) * self.scale
        return np.maximum(x @ self.a + self.b, 0) @ self.c + x @ self.d

    @classmethod
    def fit(cls, x: np.ndarray, share: np.ndarray, hidden: int = 64, epochs: int = 30, seed: int = 5) -> Router:
        """share: for each row of x the shares of parts among it and its neighbours, the targets of a cross-entropy; by Adam."""
        rng = np.random.default_rng(seed)
        mean = x.mean(0)
        scale = 1 / max(float((x - mean).std()), 1e-12)
        dim, parts = x.shape[1], share.shape[1]
        p = [
            rng.standard_normal((dim, hidden)) / np.sqrt(dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden),
            np.zeros((dim, parts))
        ]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        z = (x - mean) * scale
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for k in range(0, len(z), 128):
                rows = order[k : k + 128]
                h = np.maximum(z[rows] @ p[0] + p[1], 0)
                s = h @ p[2] + z[rows] @ p[3]
                s = np.exp(s - s.max(1, keepdims=True))
                g = (s / s.sum(1, keepdims=True) - share[rows]) / len(rows)
                back = (g @ p[2].T) * (h > 0)
                grads = [z[rows].T @ back, back.sum(0), h.T @ g, z[rows].T @ g + 1e-5 * p[3]]
                t += 1
                for q, w, a, b in zip(p, grads, m, v, strict=True):
                    a += 0.1 * (w - a)
                    b += 0.01 * (w * w - b)
                    q -= 0.01 * (1 - epoch / epochs) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return cls(mean, scale, *p)

    def route(self, x: np.ndarray, many: int) -> np.ndarray:
        """The likeliest parts, likeliest first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :many]


def learn(sample: np.ndarray, parts: int, hidden: int = 64) -> Router:
    """Fits parts and classifier, and chooses the number of probes at which the sample's own searches reach WANTED, and one more in eight for what the
    sample does not show."""
    k = min(NEIGHBOURS, len(sample) - 1)
    if parts < 2 or k < 1:
        dim = sample.shape[1]
        return Router(np.zeros(dim), 1.0, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros((dim, 1)))
    graph = _near(sample, sample, k, own=True)
    part = balanced_parts(graph, parts)
    share = np.zeros((len(sample), parts))
    np.add.at(share, (np.repeat(np.arange(len(sample)), k), part[graph].ravel()), 1 / (k + 1))
    share[np.arange(len(sample)), part] += 1 / (k + 1)
    router = Router.fit(sample, share, hidden)
    ranked = router.route(sample, parts)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None], 1)
    mine = ranked[:, 0]  # where the index puts each
    depth = np.take_along_axis(place, mine[graph], 1).ravel()
    probes = 1 + int(np.quantile(depth, WANTED, method="higher"))
    router.probes = min(parts, probes + -(-probes // 8))
    return router


def usable(column: str) -> Column:
    """Whether a vector is there, is not zero, and holds finite components only."""
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(column, lambda v: v != 0), F.lit(False))


#: A hash of the id that chooses samples.
TICKETS = 1 << 30


def _ticket() -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(TICKETS))


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if table.num_rows else np.zeros((0, dim))


def _routed(rows: DataFrame, dim: int, router: Router, inner: dict[int, Router]) -> DataFrame:
    """rows with `parts`: the part a row is indexed in, and after it, for a query, the others to look into. A part that is cut again has MOST_INNER
    numbers for its own parts."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ranked = router.route(x, router.probes)
            lists: list[list[int]] = [[] for _ in asks]
            for turn in range(ranked.shape[1]):
                own = np.arange(len(x)) if turn == 0 else np.flatnonzero(asks)
                for part in np.unique(ranked[own, turn]).tolist():
                    here = own[ranked[own, turn] == part]
                    within = inner[part].route(x[here], inner[part].probes) if part in inner else np.zeros((len(here), 1), np.int64)
                    for k, found in zip(here.tolist(), (part * MOST_INNER + within).tolist(), strict=True):
                        lists[k] += found if asks[k] else found[:1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), batch.column("asks"), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "asks", "parts"]
            )

    return save(rows.select("id", "v", "asks").mapInArrow(assign, "id bigint, v array<double>, asks boolean, parts array<int>"), "routed")


def _inner_routers(routed: DataFrame, dim: int) -> dict[int, Router]:
    """A router for each part of more than PART_ROWS rows, fitted on about INNER_SAMPLE of its rows in a task of its own."""
    part = (F.get("parts", 0) / MOST_INNER).cast("int")
    sizes = routed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS)
    sizes = F.broadcast(save(sizes, "sizes"))  # at most MOST_PARTS rows
    sample = routed.select("id", "v", part.alias("part")).join(sizes, "part").where(_ticket() < F.lit(float(TICKETS)) * INNER_SAMPLE / F.col("n"))

    def fit(table: pa.Table) -> pa.Table:
        x = _vectors(table.sort_by("id"), dim)
        parts = min(MOST_INNER, -(-table["n"][0].as_py() // PART_ROWS), max(1, len(x) // 16))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "router": pa.array([pickle.dumps(learn(x, parts, hidden=32))], pa.binary())})

    return {r.part: pickle.loads(r.router) for r in sample.groupBy("part").applyInArrow(fit, "part int, router binary").collect()}  # at most MOST_PARTS


def search(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors that `queries` holds for, its k nearest other rows found, by Euclidean distance in
    double precision.

    Nearest first, equal distances by smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
    null id, nor those of
    another length than most. Every other row is indexed, in one part. Rows with the same id and vector count once. A part of any size is dealt to
    blocks
    by a hash of the id, and so are its queries; each meets each, and the best of the blocks are merged. Parts and classifier are fitted on SAMPLE
    rows
    chosen by a hash of the id; above PART_ROWS * MOST_PARTS rows each part is cut again, by INNER_SAMPLE rows of it. Other columns are not looked at.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.transform(column, lambda v: v.cast("double")).alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = sizes[0]
    rows = rows.where(F.col("dim") == dim).drop("dim").dropDuplicates(["id", "v"])
    # A hash of the id below a bound takes about SAMPLE rows with no sort; the bound leaves room for chance.
    rows = rows.withColumn("asks", F.coalesce("asks", F.lit(False)))
    sample = _vectors(rows.where(_ticket() < min(TICKETS, int(TICKETS * SAMPLE / n))).select("id", "v").toArrow().sort_by("id"), dim)
    router = learn(sample, int(min(MOST_PARTS, max(1, -(-n // PART_ROWS)), max(1, len(sample) // 16))))
    routed = _routed(rows, dim, router, {})
    if n > PART_ROWS * MOST_PARTS:
        first = routed
        routed = _routed(rows, dim, router, _inner_routers(first, dim))
        drop(first)
    index = routed.select(F.get("parts", 0).alias("part"), "id", "v")
    asked = routed.where("asks").select(F.explode("parts").alias("part"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    pieces = lambda rows, most, to: rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(to))
    blocks = F.broadcast(save(pieces(index, BLOCK_ROWS, "blocks").join(pieces(asked, TURN_ROWS, "turns"), "part"), "blocks"))  # at most MOST_PARTS * MOST_INNER rows
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    deal = lambda id_, many: F.pmod(F.xxhash64(id_), many).cast("int")
    index = index.join(blocks, "part").select("part", deal("id", "blocks").alias("block"), spread("turns").alias("turn"), "id", "v")
    asked = asked.join(blocks, "part").select("part", spread("blocks").alias("block"), deal("query_id", "turns").alias("turn"), "query_id", "q")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = right["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            y = right["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
            asks, x = left["query_id"].to_numpy(), left["q"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            for q, a in zip(asks, x, strict=True):
                d = np.sqrt(((y - a) ** 2).sum(1))
                d[ids == q] = np.inf
                best = np.argsort(d, kind="stable")[:k]  # ids rise, so equal distances come by smaller id
                best = best[np.isfinite(d[best])]
                out[0].append(np.full(len(best), q))
                out[1].append(ids[best])
                out[2].append(d[best])
        made = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.Table.from_arrays([pa.array(made[0].astype(np.int64)), pa.array(made[1].astype(np.int64)), pa.array(made[2])], names)

    found = asked.groupBy("part", "block", "turn").cogroup(index.groupBy("part", "block", "turn")).applyInArrow(
        compare, "query_id bigint, vec_id bigint, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
