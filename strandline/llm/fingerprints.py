"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL expressions only.

A sketch is the sorted array of the K smallest 48-bit hashes of a text's distinct
shingles (SHINGLE words each; a shorter text is one shingle, a text without words has
none).  Sketches merge by union and estimate resemblance, containment and the number of
distinct shingles; while a text has fewer than K shingles the figures are exact.
Null texts are empty.  Two sketches without shingles resemble each other fully, one
without and one with not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

K, SHINGLE, BITS = 128, 5, 48
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of characters that aren't ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all shingles in order, repeats included.

    The arrays are built by chained one-element transforms, so that each is worked out
    once and not again for every use.
    """
    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        size = F.size(h)
        every = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(n)]), 64 - BITS))
        one = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(size >= n, every).when(size > 0, one).otherwise(F.expr("array()").cast("array<bigint>"))

    return F.get(F.transform(F.array(hashes), of), F.lit(0))


def sketch(text: Column, n: int = SHINGLE, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, n))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of the two."""

    def of(pair: Column) -> Column:
        union, both = pair["u"], pair["i"]
        top = F.element_at(union, -1)
        return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.filter(both, lambda x: x <= top)) / F.size(union))

    pair = F.struct(merge(a, b, k).alias("u"), F.array_intersect(a, b).alias("i"))
    return F.get(F.transform(F.array(pair), of), F.lit(0))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = F.lit(float(k - 1)) * float(1 << BITS) / (F.element_at(a, -1) + 1).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 where ``a`` has none."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def text_form(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes, six bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each distinct (id, text hash): those of the next document by descending id, the first after the last.

    Only ids, hashes and lengths are moved: a range partitioning and each row's place
    in it give the order, and a table with one row for each partition links the ends.
    Rows with equal id and text are one document; of rows with equal ids the order is
    by the text's hash.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    g = docs.select(F.col(id_col).alias("d"), F.xxhash64(t).alias("h"), F.char_length(t).alias("n")).distinct()
    order = [F.col("d").desc_nulls_last(), F.col("h").desc()]
    g = g.repartitionByRange(common.parts_for(docs.sparkSession), *order).sortWithinPartitions(*order)
    g = common.stored(g.withColumn("at", F.monotonically_increasing_id()), "order")
    ends = g.groupBy(F.shiftright("at", 33).alias("p")).agg(F.min("at").alias("first"), F.max("at").alias("last")).collect()
    # One row for each partition of the range partitioning, whatever the number of documents.
    ends = sorted(ends)
    links = [(r["last"], ends[(k + 1) % len(ends)]["first"]) for k, r in enumerate(ends)]
    links = docs.sparkSession.createDataFrame(links, "at long, over long")
    g = g.join(F.broadcast(links), "at", "left").withColumn("after", F.coalesce("over", F.col("at") + 1))
    nxt = g.select(F.col("at").alias("after"), F.col("d").alias("next_d"), F.col("h").alias("next_h"))
    return g.select("d", "h", "n", "after").join(nxt, "after").drop("after")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its last third replaced by the beginning of the next document's.

    Returns ``id_col``, text, edited and next_sketch.  Texts are dealt once, by id and
    hash; a third of each and its sketch go to the document before it.
    """
    d = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    links = common.stored(successors(docs, id_col, text_col), "links").withColumn("m", F.floor(F.col("n") / 3).cast("int"))
    donors = d.join(links.withColumnsRenamed({"d": "to_d", "h": "to_h"}), F.col("d").eqNullSafe(F.col("next_d")) & (F.col("h") == F.col("next_h")))
    donors = donors.select("to_d", "to_h", "m", F.expr("left(text, m)").alias("given"), sketch(F.col("text")).alias("next_sketch"))
    if links.count() < docs.count():
        # A repeated row gives once.
        donors = donors.dropDuplicates(["to_d", "to_h"])
    both = d.join(donors, F.col("d").eqNullSafe(F.col("to_d")) & (F.col("h") == F.col("to_h")))
    return both.select(F.col("d").alias(id_col), "text", F.concat(F.expr("left(text, char_length(text) - m)"), "given").alias("edited"), "next_sketch")
