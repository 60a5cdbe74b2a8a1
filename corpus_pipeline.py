"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, mixing, packing, setjoin, substrings, toxicity

#: Near duplicates: words of a shingle, and the least similarity in hundredths.
WORDS, SIMILAR = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic.  Null texts count as empty and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    (out,) = common.fresh(docs, "toxicity")
    return toxicity.scored(docs, model, out=out).where(F.col(out) < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates one document: that of the smallest id, then the smallest text hash.

    Texts without words, and rows without an id, stay, each as it is.  Different texts of one id
    are different documents; of rows that repeat id and text one stays.
    """
    rows = setjoin.grouped(docs, n=WORDS, num=SIMILAR, den=100)
    rows = rows.where("d is not null and size > 0")
    first = rows.groupBy("root").agg(F.min(F.struct("d", "h")).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    met = common.salted_join(rows, first, "root", "d")
    gone = common.stored(met.where(F.struct("d", "h") != F.col("first")).select("d", "h").distinct(), "gone")
    names = common.fresh(docs, "d", "h")
    gone = gone.toDF(*names)
    h = F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    out = docs.join(common.hinted(gone), (F.col("doc_id") == F.col(names[0])) & (h == F.col(names[1])), "left_anti")
    if rows.groupBy("d", "h").count().where("count > 1").limit(1).count():
        again = out.where("doc_id is not null and text is not null").dropDuplicates(["doc_id", "text"])
        out = again.unionByName(out.where("doc_id is null or text is null"))
    return out.select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier; documents of which no word is left go."""
    words, removed, kept = common.fresh(docs, "n_words", "n_removed", "kept")
    out = substrings.deduplicated(docs, out=(words, removed, kept))
    out = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    changed = F.col(removed) > 0
    out = out.withColumn("text", F.when(changed, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those that it doesn't take go."""
    d, h, key, times, rows, copy = common.fresh(docs, "d", "h", "key", "times", "rows", "copy")
    taken = mixing.mixed(docs).groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.sum("times").alias(times), F.count("*").alias(rows))
    taken = common.stored(taken.where(F.col(times) > 0), "times")
    own = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    if taken.where(F.col(rows) > 1).limit(1).count():
        # Rows that repeat id and text share one entry, which holds the copies of all.
        own = own.dropDuplicates(["doc_id", key])
    both = own.join(common.hinted(taken), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(h)))
    both = both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return both.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("substring dedup", remove_repeated_passages),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: A trained classifier, random draws and packing have no SQL form; brute-force versions are in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
