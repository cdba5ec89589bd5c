"""Document fingerprints by I-Match, in DataFrame functions alone.

A document's terms are its distinct words; kept are those whose document frequency lies within a band, so neither the words of every text nor the rare
ones that typing errors make. The
kept terms, each a 60-bit number from its md5, are sorted and hashed, once as a whole and once for each of several random subsets of the lexicon:
equal hashes say that two texts have the same kept terms of that subset.
Large subsets tell copies apart, small ones are still equal after much of a text has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

#: A term is kept that at least and at most this share of the documents holds. The lower share bounds the lexicon: it has at most 1/share times the
#: mean number of distinct words of a document.
BAND = (0.001, 0.05)
#: The lexicon is broadcast while it has at most so many terms (16 bytes each); beyond it, terms are shuffled to it.
TRAVELS = 1 << 20
#: Random subsets of the lexicon, dealt by bits of a term's number: a term is in a list where `bits` bits from `at` on equal `value`, and in the
#: subset of that list that the next `more` bits number.
#: Lists: (at, bits, value, more). 16 subsets of a sixteenth each, in four lists, 16 of a sixty-fourth, 32 of a 256th.
SUBSETS = ((0, 2, 0, 2), (0, 2, 1, 2), (0, 2, 2, 2), (0, 2, 3, 2), (4, 2, 0, 4), (10, 3, 0, 5))


def terms(text: Column) -> Column:
    """Distinct words, A-Z lower-cased, in order of first use."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, r"[\x20\x09-\x0D]+", -1), ""))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """x (xxhash64, for joins) and h (the number) of the terms within the band, counted over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    kept = counts.where((F.col("df") >= max(1.0, band[0] * n)) & (F.col("df") <= max(1.0, band[1] * n)))
    return save(kept.select(F.xxhash64("t").alias("x"), F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("bigint").alias("h")), "lexicon")


def dealt_terms(kept: Column) -> dict[str, Column]:
    """The lists of SUBSETS, so that a subset looks at few terms only."""
    return {
        f"_list{k}": F.filter(kept, lambda h: F.shiftright(h, at).bitwiseAND((1 << bits) - 1) == value) for k,
        (at, bits, value, _) in enumerate(SUBSETS)
    }  # noqa: B023


def _hash(numbers: Column) -> Column:
    return F.md5(F.array_join(numbers.cast("array<string>"), " "))


def signatures(kept: str, every: Column) -> Column:
    """The hashes, joined by dots, of the sorted kept terms (where there are none, of all terms), and of those in each subset, from the columns of
    dealt_terms(); empty where a subset has none."""
    rest = F.md5(F.array_join(F.sort_array(every), " "))
    whole = F.substring(F.when(F.size(kept) > 0, _hash(F.col(kept))).otherwise(rest), 1, 16)

    def parts(k: int, at: int, bits: int, more: int) -> Column:
        def one(j: Column) -> Column:
            own = F.filter(f"_list{k}", lambda h: F.shiftright(h, at + bits).bitwiseAND((1 << more) - 1) == j)
            return F.when(F.size(own) == 0, "").otherwise(F.substring(_hash(own), 1, 8))

        return F.array_join(F.transform(F.array(*[F.lit(j).cast("bigint") for j in range(1 << more)]), one), ".")

    return F.concat_ws(".", whole, *[parts(k, at, bits, more) for k, (at, bits, _, more) in enumerate(SUBSETS)])


def fingerprints(docs: DataFrame, keys: list[str], text: str, words: DataFrame, to: str, within: list[str] | None = None) -> DataFrame:
    """The columns of docs and `to`, the signatures of the text. keys, and within, name a text; none is null.

    The hashes of terms are joined with the lexicon and gathered again by keys; where docs are dealt by these keys, that shuffles nothing.
    """
    every = [*keys, *(within or ())]
    held = docs.select(*every, F.explode(terms(F.col(text))).alias("_t")).select(*every, F.xxhash64("_t").alias("x"))
    kept = held.join(words, "x").groupBy(*every).agg(F.collect_set("h").alias("_kept"))
    own = F.col("_kept")
    if within is not None:
        this = F.struct(*within)
        kept = kept.groupBy(*keys).agg(F.collect_list(F.struct(this.alias("w"), "_kept")).alias("_kept"))
        own = F.get(F.filter("_kept", lambda k: k["w"] == this), F.lit(0))["_kept"]
    rows = docs.join(kept, keys, "left").withColumn("_own", F.sort_array(F.coalesce(own, F.array().cast("array<bigint>"))))
    return rows.withColumns(dealt_terms(F.col("_own"))).withColumn(to, signatures("_own", terms(F.col(text)))).select(*docs.columns, to)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets of which either text has a term."""
    parts = lambda c: F.split(c, r"\.", -1)
    pairs = F.filter(F.arrays_zip(parts(a).alias("x"), parts(b).alias("y")), lambda p: (p["x"] != "") | (p["y"] != ""))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.size(pairs)


def next_ids(keys: DataFrame) -> DataFrame:
    """doc_id and next_id, the next larger one (after the largest: the smallest), for distinct doc_ids.

    Ids are dealt out by range, and each part finds its own successors; only the least id of each part, one row a part, is looked at in one place.
    """
    parts = save(keys.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ordered")
    least = parts.groupBy("part").agg(F.min("doc_id").alias("least"))
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    least = least.select("part", F.coalesce(F.lead("least").over(whole), F.first("least").over(whole)).alias("after"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return parts.withColumn("inside", inside).join(F.broadcast(least), "part").select("doc_id", F.coalesce("inside", "after").alias("next_id"))  # a row a part


def fingerprint_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints every text and the same text with its later half replaced by the start of the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text). A
    null text counts as empty. The next document is that of the next larger doc_id; of several rows with that doc_id,
    the one whose text has the least xxhash64. Rows with a null doc_id stand outside the order: their next document is empty. Texts without kept terms
    are hashed by all their terms. Repeated rows come back as often. Other columns are not looked at.
    """
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")  # a cast that does nothing would keep Spark from shuffling once for all
    base = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(base, band)
    if words.count() <= TRAVELS:
        words = F.broadcast(words)
    key = ["doc_id", "version"]
    rows = base.where("doc_id is not null").withColumn("version", F.xxhash64("text"))
    versions = save(rows.select(*key).distinct(), "versions")
    first = versions.groupBy("doc_id").agg(F.min("version").alias("next_version"))
    follows = next_ids(first.select("doc_id")).join(first.withColumnRenamed("doc_id", "next_id"), "next_id")
    follows = save(versions.join(follows, "doc_id"), "follows")

    # Texts are dealt by key once, for all that follows; then each one's head goes to the document after it.
    dealt = rows.repartition(*key)
    again = F.lag(F.lit(1)).over(Window.partitionBy(*key).orderBy("doc_id"))
    single = dealt.withColumn("again", again).where("again is null").drop("again")
    own = fingerprints(single, key, "text", words, "fingerprint").drop("text")
    after = single.select(F.col("doc_id").alias("next_id"), F.col("version").alias("next_version"), F.col("text").alias("next_text"))
    n = F.char_length("text")
    head = F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")).alias("head")
    heads = dealt.join(follows, key).select(*key, "next_id", "next_version", n.alias("n_chars"), head)
    edited = F.concat("head", F.substring("next_text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))).alias("edited")
    joined = heads.join(after, ["next_id", "next_version"]).select("next_id", "next_version", *key, "n_chars", edited)
    # Only one doc_id has this next_id, so its version tells its texts apart.
    out = fingerprints(
        joined, ["next_id", "next_version"], "edited", words, "edited_fingerprint", within=key
    ).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    out = out.join(own.toDF("next_id", "next_version", "next_fingerprint"), ["next_id", "next_version"]).join(own, key)

    outside = save(base.where("doc_id is null").select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "outside")
    outside = outside.select("*", n.alias("n_chars"), head, F.lit("").alias("empty"))
    outside = fingerprints(
        fingerprints(fingerprints(outside, ["row"], "text", words, "fingerprint"), ["row"], "head", words, "edited_fingerprint"), ["row"], "empty",
        words, "next_fingerprint"
    )
    return _result(out).unionByName(_result(outside.withColumn("edited_sha256", F.sha2("head", 256))))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )
