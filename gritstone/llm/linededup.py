"""Line dedup by pairwise alignment: documents that share rare lines are aligned with patience diff, and the later one loses the common blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, save, slices

#: A line of fewer characters, blanks at its ends apart, repeats by chance: it finds no partners, and goes only within a block that holds a longer
#: line.
LEAST_CHARS = 20


def patience(a: Sequence[int | None], b: Sequence[int | None]) -> list[tuple[int, int]]:
    """Index pairs of aligned equal lines, rising in both; None equals nothing.

    Equal heads and tails align first; between them the lines that are unique on both sides, by the longest rising run of their places; then each gap
    alike.
    Where a gap has common lines but no unique ones, the first, second, ... occurrences of a line count as different lines.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, i1, j, j1 = gaps.pop()
        while i < i1 and j < j1 and a[i] is not None and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i1 and j < j1 and a[i1 - 1] is not None and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i == i1 or j == j1:
            continue
        anchors = _rising(_unique(a, i, i1, b, j, j1) or _numbered(a, i, i1, b, j, j1))
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (i1, j1)]
            gaps += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(edges, edges[1:], strict=False) if p + 1 < q and s + 1 < t]
    return sorted(out)


def _unique(a, i, i1, b, j, j1) -> list[tuple[int, int]]:
    left, right = Counter(a[i:i1]), Counter(b[j:j1])
    places = {b[q]: q for q in range(j, j1) if b[q] is not None and right[b[q]] == 1}
    return [(p, places[a[p]]) for p in range(i, i1) if left[a[p]] == 1 and a[p] in places]


def _numbered(a, i, i1, b, j, j1) -> list[tuple[int, int]]:
    places, seen = {}, Counter()
    for q in range(j, j1):
        if b[q] is not None:
            places[b[q], seen[b[q]]] = q
            seen[b[q]] += 1
    seen, out = Counter(), []
    for p in range(i, i1):
        if a[p] is not None:
            if (a[p], seen[a[p]]) in places:
                out.append((p, places[a[p], seen[a[p]]]))
            seen[a[p]] += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, which rise in the first, that rises in the second too."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(ends, q)
        before[k] = at[n - 1] if n else -1
        ends[n:n + 1], at[n:n + 1] = [q], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(kept: Sequence[int], lines: Sequence[int]) -> list[int]:
    """The places in `lines` of the aligned blocks, runs that follow each other in both documents, that hold a long line. A long line's number is
    even, a short one's odd."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(kept, lines), (-2, -2)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(lines[k] % 2 == 0 for k in block):
                out += block
            block = []
        if i >= 0:
            block.append(j)
        last = (i, j)
    return out


def _aligned(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, version, the places `deleted` and the lines `covered` by them, for each of pairs (doc_id, version, first) that are aligned anywhere."""
    own = lines.dropDuplicates(["doc_id", "version"])
    both = pairs.join(own, ["doc_id", "version"]).join(lines.select(F.col("doc_id").alias("first"), F.col("lines").alias("kept")), "first")
    names = ["doc_id", "version", "deleted", "covered"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "lines"), "kept"):
            gone, covered = [], []
            for a, b in zip(batch.column("kept").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                places = common_blocks(a, b)
                gone.append(places)
                covered.append(list({b[k] for k in places}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(gone, pa.list_(pa.int32())), pa.array(covered, pa.list_(pa.int64()))],
                names
            )

    found = both.select("doc_id", "version", "kept", "lines").mapInArrow(align, "doc_id bigint, version bigint, deleted array<int>, covered array<bigint>")
    return save(found.where(F.size("deleted") > 0), "aligned")


def deleted_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, version (xxhash64 of the text) and deleted, the indices of the lines to delete, for each document that loses any.

    Partners come from the lines of least_chars characters or more that an earlier document holds, in three rounds. First a document is aligned with
    the
    first holder (the one of least doc_id) of its rarest shared lines, so that one of a group of copies, of any size, meets one document. Then, for
    lines that no block
    covers yet, with these lines' first holders. What still isn't covered stands in another order there: such lines are kept, and so a document is
    last
    aligned with the first of the documents that kept one of its own. A document has at most a pair for each line and round. Only hashes of lines
    travel, the texts don't.
    """
    text = F.coalesce("text", F.lit(""))
    even = lambda x: F.shiftleft(F.xxhash64(F.trim(x)), 1)
    hashes = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(F.trim(x)) >= least_chars, even(x)).otherwise(even(x) + 1))
    lines = save(docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("version"), hashes.alias("lines")), "lines")
    key = ["doc_id", "version"]

    # What is gathered of a line is a table of its own, so that adaptive execution can split the holders of a frequent one in the join.
    held = lines.select(*key, F.explode(F.array_distinct(F.filter("lines", lambda x: x % 2 == 0))).alias("line"))
    firsts = save(held.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where("docs > 1"), "first-holders")
    shared = save(held.join(firsts, "line").where("doc_id > first"), "shared-lines")
    rarest = F.min("docs").over(Window.partitionBy(*key))
    pairs = save(shared.withColumn("rarest", rarest).where("docs = rarest").select(*key, "first").distinct(), "pairs")
    found = [_aligned(pairs, lines)]

    left = lambda rows, made: rows.join(made.select(*key, F.explode("covered").alias("line")), [*key, "line"], "left_anti")
    missed = save(left(shared, found[0]), "uncovered")
    more = save(missed.select(*key, "first").distinct().join(pairs, [*key, "first"], "left_anti"), "pairs")
    found.append(_aligned(more, lines))

    crossed = save(left(missed, found[1]), "uncovered")
    keepers = save(crossed.groupBy("line").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1"), "keepers")
    last = crossed.join(keepers, "line").where("doc_id > keeper").select(*key, F.col("keeper").alias("first")).distinct()
    found.append(_aligned(last.join(pairs.unionByName(more), [*key, "first"], "left_anti"), lines))
    drop(lines, firsts, shared, pairs, missed, more, crossed, keepers)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("deleted"))).alias("deleted"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The columns of docs with text less its deleted lines, and _lines and _deleted, the numbers of lines it had and lost.

    The earlier of two documents is the one of smaller doc_id, and stays as it is before that pair; as each line is compared with
    originals, the first document that holds a line keeps it. Lines of under least_chars characters, blank ones too, find no partners and
    go only with a block that holds a longer line. A null text stays null and has no line, an empty one has one line. A null doc_id is left alone.
    Rows with the same
    doc_id are not compared with each other. Columns of docs named _lines or _deleted are replaced; others pass through.
    """
    names = [c for c in docs.columns if c not in ("_lines", "_deleted")]
    gone = deleted_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), least_chars)
    rows = docs.select(F.struct(*names).alias("row")).withColumn("doc_id", F.col("row.doc_id").cast("bigint")).withColumn(
        "version", F.xxhash64(F.coalesce("row.text", F.lit("")))
    )
    rows = rows.join(gone, ["doc_id", "version"], "left")
    lines = F.split("row.text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("deleted", k.cast("int"))), "\n")
    text = F.when(F.col("deleted").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(left)
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return rows.select(
        *columns, F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).alias("_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).alias("_deleted")
    )
