"""The thin queries: each takes its rows through its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learned from the rows that aren't held out.

    Null and empty texts get the score of an empty text.
    """
    from strandline.llm import toxicity

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = toxicity.fit(docs.where(~F.col("held_out")), labels)
    out = toxicity.scored(docs, model).select("doc_id", "held_out", "score")
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as files of patched blocks and read back from them."""
    import public_tokenizers

    from strandline.llm import pfor

    path = common.new_dir(spark, "ids")
    pfor.write(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pfor.read(spark, path, with_ids=False)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    Rows that repeat an id and a text are one document and give one row each.
    """
    from strandline.llm import fingerprints as fp

    rows = fp.edited(common.documents(spark, sf_dir).select("doc_id", "text"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fp.sketch(F.col("text")).alias("own"), fp.sketch(F.col("edited")).alias("other"), "next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fp.text_form(F.col("own")).alias("fingerprint"), fp.text_form(F.col("other")).alias("edited_fingerprint"),
        fp.resemblance(F.col("own"), F.col("other")).alias("near_edited"), fp.resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        fp.distinct_shingles(F.col("own")).alias("distinct_shingles"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there; shards differ by one row at most."""
    from strandline.llm import sharding

    out = sharding.sharded(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 3-word shingles and its component at a Jaccard similarity of 0.9."""
    from strandline.llm import setjoin

    return setjoin.joined(common.documents(spark, sf_dir).select("doc_id", "text"), n=3, num=90, den=100)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product found for every twentieth vector."""
    from strandline.llm import neighbours

    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    import public_tokenizers

    from strandline.llm import packing

    out = packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written into archives and read back from them."""
    from strandline.llm import warc

    path = common.new_dir(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path, with_payload=False).drop("uri")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    from strandline.llm import mixing

    out = mixing.mixed(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document 20-word windows that start earlier cover, and what is left."""
    from strandline.llm import substrings

    out = substrings.deduplicated(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster of 40 after five rounds on whole numbers, its distance, the sums of distances and its centroid's digest."""
    from strandline.llm import lloyd

    out = lloyd.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", lloyd.centroid_digest("centroid").alias("centroid_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    from strandline.llm import tput

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return tput.ranked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op13_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    from strandline.llm import harmonic

    out = harmonic.pack(common.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Squared distances are sums of products of whole numbers in doubles, which are exact at this size."""
    parts = [
        """v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::double) as x, sha256('2:' || vec_id) as o from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"c0 as materialized (select row_number() over (order by o, x) - 1 as j, x as c from v where vec_id is not null order by o, x limit {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (select r, j, d from (select v.r, c.j, list_inner_product(v.x, v.x) + list_inner_product(c.c, c.c) - 2 * list_inner_product(v.x, c.c) as d from v, c{n} c)
        qualify row_number() over (partition by r order by d, j) = 1)""")
        if n < rounds:
            parts.append(f"""s{n} as materialized (select j, list(m order by p) as c from (select j, p, floor(sum(u) / count(*)) as m from (select a.j, unnest(v.x) as u, generate_subscripts(v.x, 1) as p from a{n} a join v using (r)) group by j, p) group by j)""")
            parts.append(f"c{n + 1} as materialized (select c.j, coalesce(s.c, c.c) as c from c{n} c left join s{n} s using (j))")
    return f"""with {', '.join(parts)}
    select v.vec_id, a.j::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
      sha256(array_to_string(list_transform(c.c, lambda x: x::bigint), ',')) as centroid_sha256
    from v join a{rounds} a using (r) join c{rounds} c on c.j = a.j"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SEARCH_SQL = f"""with t as materialized (select r, doc_id, unnest(ts) as term from (select row_number() over () as r, doc_id, {_TERMS} as ts from documents)),
    c as (select r, doc_id, term, count(*) as tf from t group by all), n as (select r, count(*) as n from t group by r),
    z as (select count(*) as docs, sum(n)::bigint as words from n), f as (select term, count(*) as df from c group by term),
    q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from f, z),
    s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::bigint as score from q join w using (term) join c using (term) join n using (r), z group by item_id, r, doc_id)
    select item_id, row_number() over (partition by item_id order by score desc, doc_id, r)::int as rank, doc_id, score from s where score > 0
    qualify row_number() over (partition by item_id order by score desc, doc_id, r) <= 50"""

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_token_ids, op3_fingerprints, op4_sharding, op5_ngram_jaccard, op6_neighbours, op7_packing, op8_warc, op9_mixing, op10_substring_dedup, op11_centroids, op12_search, op13_harmonic)
}

ORACLE = {"op11_centroids": _centroids_sql(), "op12_search": _SEARCH_SQL}
