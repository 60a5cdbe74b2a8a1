"""Named queries over the driver's tables, and the same in SQL.

The tables stand in for the entities of the operators: documents for reads, lineitem
for hits and allele counts, events for variants and segments, part for markers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import sequence as S
from strandline.operators import annotation, hits, intervals, mappings, maps, reads, selection, statistics, variants
from strandline.plans import pipelines
from strandline.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (tables) under its name; ``tables(name)`` reads a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _reads(t) -> DataFrame:
    """Documents as reads; a character's code is its quality."""
    d = t("documents")
    return d.select(F.col("doc_id").alias("name"), F.col("text").alias("seq"), S.phred(F.col("text")).alias("qual"), "source")


def _snvs(t) -> DataFrame:
    """Events as variants: 150 or so references of 100,000 bases."""
    start = (F.col("event_id") * 7919) % 100_000
    return t("events").select(F.col("event_id").alias("snv_id"), F.col("user_id").alias("ref"), start.alias("start"), (start + 1).alias("end"), F.lit(100_000).cast("long").alias("ref_len"), "event_type", "value")


def _counts(t) -> DataFrame:
    """Line items as allele counts by read group."""
    kind = F.when(F.col("l_returnflag") == "N", "INVARIANT").otherwise("SNP")
    return t("lineitem").select(F.col("l_orderkey").alias("snv_id"), F.concat("l_returnflag", "l_linestatus").alias("allele"), kind.alias("kind"), F.col("l_suppkey").alias("rg"), F.col("l_quantity").cast("long").alias("n"))


_COUNTS = "(SELECT l_orderkey snv_id, l_returnflag || l_linestatus allele, CASE WHEN l_returnflag = 'N' THEN 'INVARIANT' ELSE 'SNP' END kind, l_suppkey rg, CAST(l_quantity AS BIGINT) n FROM lineitem)"
_SNVS = "(SELECT event_id snv_id, user_id AS ref, (event_id * 7919) % 100000 AS \"start\", (event_id * 7919) % 100000 + 1 AS \"end\", 100000 ref_len, event_type, value FROM events)"


def _parts(t) -> DataFrame:
    """Line items as aligned parts: orders are queries, parts are subjects."""
    q = F.col("l_quantity").cast("long")
    return t("lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("subject"), F.col("l_linenumber").alias("match_rank"), F.lit(1).alias("part_rank"), q.alias("q_start"), (q + F.col("l_linenumber") * 3).alias("q_end"), q.alias("s_start"), (q + 10).alias("s_end"),
        F.lit(100).cast("long").alias("q_len"), (90 + 100 * F.col("l_discount")).alias("similarity"), F.pow(F.lit(10.0), -F.col("l_quantity")).alias("expect"),
    )


_PARTS = "(SELECT l_orderkey query, l_partkey subject, l_linenumber match_rank, CAST(l_quantity AS BIGINT) q_start, CAST(l_quantity AS BIGINT) + l_linenumber * 3 q_end, 90 + 100 * l_discount similarity, pow(10.0, -l_quantity) expect, l_quantity FROM lineitem)"
_MERGED = """m0 AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM iv),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM m0),
mm AS (SELECT k, min(s) s, max(e) e FROM m1 GROUP BY k, g)"""
_IV = "WITH iv AS (SELECT l_orderkey k, CAST(l_quantity AS BIGINT) s, CAST(l_quantity AS BIGINT) + l_linenumber * 3 e FROM lineitem), "
# Each segment once: equal ones have no order that two windows share, and unions don't change.
_IV_ONCE = _IV.replace("(SELECT ", "(SELECT DISTINCT ")
_FREE = "fr AS (SELECT k, coalesce(lag(e) OVER w + 1, 0) s, s - 1 e FROM mm WINDOW w AS (PARTITION BY k ORDER BY s) UNION ALL SELECT k, max(e) + 1, 99 FROM mm GROUP BY k), free AS (SELECT * FROM fr WHERE e >= s)"


def _intervals(t) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return t("lineitem").select(F.col("l_orderkey").alias("k"), q.alias("start"), (q + F.col("l_linenumber") * 3).alias("end"))


def _lengths(t) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.lit(100).cast("long").alias("length")).distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["clean_reads"](spark, sf_dir)


# Reads.


@query()
def clean_reads(t):
    out = pipelines.clean(_reads(t), "solexa", quality_threshold=60)
    return out.groupBy("source").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"))


@query(f"SELECT doc_id AS name, translate(text, '{S._LOWER}', '{S._UPPER}') AS seq FROM documents")
def up_case(t):
    return reads.up_case(_reads(t)).select("name", "seq")


@query("SELECT doc_id AS name, translate(text, '.0123', 'NACGT') AS seq FROM documents")
def double_encode(t):
    return _reads(t).select("name", S.double_encode(F.col("seq")).alias("seq"))


@query(f"SELECT doc_id || '_complemented' AS name, reverse(translate(text, '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}')) AS seq FROM documents")
def reverse_complement(t):
    return reads.reverse_complement(_reads(t).drop("qual").withColumn("name", F.col("name").cast("string"))).select("name", "seq")


@query("SELECT doc_id AS name, substr(text, 4, length(text) - 8) AS seq FROM documents WHERE length(text) >= 9")
def edge_trim(t):
    return reads.trim_and_mask(reads.trim_edges(_reads(t).drop("qual"), 3, 5)).select("name", "seq")


@query(f"SELECT doc_id AS name, replace(translate(text, '{S._LOWER}', '{S._UPPER}'), 'THE', 'the') AS seq FROM documents")
def mask_words(t):
    return reads.trim_and_mask(reads.mask_words(reads.up_case(_reads(t).drop("qual")), ["THE"]), trim=False).select("name", "seq")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) i FROM documents WHERE length(text) > 0),
q AS (SELECT doc_id, avg(least(greatest(ascii(ch) - 33, 0), 93)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) m FROM c)
SELECT doc_id AS name, CAST(count(*) AS BIGINT) AS bases, CAST(sum(CASE WHEN m > 60 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM q GROUP BY doc_id""")
def quality_window_mean(t):
    r = _reads(t).where(F.length("seq") > 0).withColumn("m", reads.window_means(F.col("qual"), 4))
    return r.select("name", F.size("m").cast("long").alias("bases"), F.size(F.filter("m", lambda x: x > 60)).cast("long").alias("good"))


@query("""SELECT doc_id AS name FROM (SELECT doc_id, list_transform(string_split(text, ''), lambda ch: least(greatest(ascii(ch) - 33, 0), 93)) q FROM documents WHERE length(text) > 0)
WHERE len(list_filter(q, lambda x: x = 0)) < 2 AND list_sum(q[1:11]) / 10.0 >= 50""")
def solid_quality_filter(t):
    return reads.solid_quality(_reads(t).where(F.length("seq") > 0), 10, 50).select("name")


@query("SELECT doc_id AS name, CAST(length(regexp_replace(upper(text), '[^ATCG]', '', 'g')) AS BIGINT) AS unmasked FROM documents WHERE length(regexp_replace(upper(text), '[^ATCG]', '', 'g')) > 300")
def length_filter_unmasked(t):
    r = reads.longer_than(reads.up_case(_reads(t)), 300, count_masked=False)
    return r.select("name", S.unmasked_length(F.col("seq")).cast("long").alias("unmasked"))


@query("""WITH r AS (SELECT doc_id, regexp_extract_all(text, '([A-Z]+)', 1) p FROM documents WHERE regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]')),
x AS (SELECT doc_id, unnest(p) s, generate_subscripts(p, 1) i FROM r)
SELECT doc_id || '_' || i AS name, s AS seq FROM x WHERE length(s) >= 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents WHERE NOT regexp_matches(text, '[a-z]') OR NOT regexp_matches(text, '[A-Z]')""")
def masked_run_split(t):
    return reads.split_masked(_reads(t).select(F.col("name").cast("string").alias("name"), "seq"), 2)


@query(f"""WITH c AS (SELECT CAST(unnest(range(30)) AS INTEGER) pos, translate(text, '{S._LOWER}', '{S._UPPER}') u FROM documents), b AS (SELECT pos, substr(u, pos + 1, 1) x FROM c)
SELECT pos, sum(CAST(x = 'A' AS INT)) / CAST(count(*) AS DOUBLE) freq_a, sum(CAST(x = 'C' AS INT)) / CAST(count(*) AS DOUBLE) freq_c, sum(CAST(x = 'G' AS INT)) / CAST(count(*) AS DOUBLE) freq_g, sum(CAST(x = 'T' AS INT)) / CAST(count(*) AS DOUBLE) freq_t
FROM b WHERE x IN ('A', 'C', 'G', 'T') GROUP BY pos""")
def nucleotide_frequencies(t):
    return reads.nucleotide_frequencies(_reads(t))


@query("""WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') s FROM documents), c AS (SELECT unnest(range(CAST(floor(length(s) / 3) AS BIGINT))) i, s FROM d WHERE length(s) >= 3)
SELECT substr(s, CAST(3 * i + 1 AS BIGINT), 3) codon, count(*) n FROM c GROUP BY 1""")
def codon_usage(t):
    d = t("documents").select(F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return reads.codon_usage(d).select("codon", "n")


@query("""WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') s FROM documents), c AS (SELECT doc_id, unnest(range(1, length(s))) i, s FROM d WHERE length(s) >= 2),
p AS (SELECT doc_id, i, s, substr(s, i, 2) x FROM c)
SELECT doc_id AS name, substr(any_value(s), 1, 1) || string_agg(CASE WHEN x IN ('AA', 'CC', 'GG', 'TT') THEN '0' WHEN x IN ('AC', 'CA', 'GT', 'TG') THEN '1' WHEN x IN ('AG', 'GA', 'CT', 'TC') THEN '2' ELSE '3' END, '' ORDER BY i) AS colours FROM p GROUP BY doc_id""")
def colour_space(t):
    d = t("documents").select(F.col("doc_id").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s")).where(F.length("s") >= 2)
    return d.select("name", S.to_colour_space(F.col("s")).alias("colours"))


@query("SELECT doc_id AS name, CAST(list_sum(list_transform(string_split(text, ''), lambda ch: CAST(floor(10 * log10(pow(10.0, least(greatest(ascii(ch) - 33, 0), 93) / 10.0) + 1)) AS BIGINT))) AS BIGINT) AS total FROM documents WHERE length(text) > 0")
def solexa_quality(t):
    q = S.solexa_to_phred(F.col("qual"))
    return _reads(t).where(F.length("seq") > 0).select("name", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query()
def microsatellites(t):
    d = t("documents").select(F.col("doc_id").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return reads.microsatellites(d, min_length=8)


_AT = "strpos('TCAG', substr(s, CAST(f + 3 * k + {} AS INT), 1)) - 1"
_CODON = f"substr('{S._CODONS}', CAST(1 + 16 * ({_AT.format(1)}) + 4 * ({_AT.format(2)}) + {_AT.format(3)} AS INT), 1)"


@query(f"""WITH d AS (SELECT doc_id AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') s FROM documents), t AS (SELECT name, '+' strand, s FROM d UNION ALL SELECT name, '-', translate(reverse(s), 'ACGT', 'TGCA') FROM d),
p AS (SELECT name, strand, s, f, string_split(array_to_string(list_transform(range(0, (length(s) - f) // 3), lambda k: {_CODON}), ''), '*') parts FROM t, range(0, 3) x(f)),
g AS (SELECT name, strand, s, f, parts, unnest(parts) seg, generate_subscripts(parts, 1) i FROM p), o AS (SELECT *, strpos(seg, 'M') m, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) ahead FROM g WHERE strpos(seg, 'M') > 0),
r AS (SELECT name, strand, s, CAST(f + 3 * (ahead + m - 1) AS INT) a, CAST(f + 3 * (ahead + length(seg) - 1) + 2 AS INT) b, substr(seg, CAST(m AS INT)) pep FROM o)
SELECT name, strand, a AS "start", b AS "end", substr(s, a + 1, b - a + 1) AS dna, pep FROM r WHERE b - a + 1 >= 30 QUALIFY row_number() OVER (PARTITION BY name ORDER BY b - a DESC, strand DESC, a) = 1""")
def longest_orfs(t):
    d = t("documents").select(F.col("doc_id").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return reads.longest_orf(d)


@query("SELECT doc_id AS name, text AS seq FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def sample_reads(t):
    return reads.sample(_reads(t).select("name", "seq"), 100, seed=7)


# Intervals.


@query(_IV_ONCE + _MERGED + " SELECT k, s AS \"start\", e AS \"end\" FROM mm")
def merge_intervals(t):
    return intervals.merge(_intervals(t), "k")


@query(_IV_ONCE + _MERGED + ", " + _FREE + " SELECT k, s AS \"start\", e AS \"end\" FROM free")
def complement_intervals(t):
    return intervals.complement(intervals.merge(_intervals(t), "k"), _lengths(t), "k")


@query(_IV + _MERGED + ", " + _FREE + ", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e - s DESC, s) n FROM free) SELECT k, s AS \"start\", e AS \"end\", e - s + 1 AS free_length FROM r WHERE n = 1")
def longest_free_region(t):
    return intervals.longest_free(intervals.merge(_intervals(t), "k"), _lengths(t), "k")


@query(_IV_ONCE + _MERGED + " SELECT k, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM mm GROUP BY k")
def covered_length(t):
    return intervals.covered_length(_intervals(t), "k")


@query(f"SELECT v.snv_id, s.snv_id AS segment FROM {_SNVS} v JOIN {_SNVS} s ON v.ref = s.ref AND s.event_type = 'purchase' AND v.\"start\" BETWEEN s.\"start\" AND s.\"start\" + 500")
def range_join(t):
    v = _snvs(t)
    seg = v.where("event_type = 'purchase'").select("ref", F.col("snv_id").alias("segment"), F.col("start").alias("s"), (F.col("start") + 500).alias("e"))
    return intervals.range_join(v, seg, "ref", "start", "s", "e", 1000).select("snv_id", "segment")


# Hits.


@query(f"SELECT query, subject, match_rank FROM {_PARTS} WHERE similarity >= 95")
def hits_score_threshold(t):
    return hits.score_threshold(_parts(t), "similarity", least=95).select("query", "subject", "match_rank")


@query(f"SELECT query, subject, match_rank FROM (SELECT *, first_value(l_quantity) OVER (PARTITION BY query ORDER BY match_rank, subject, q_start) b FROM {_PARTS}) WHERE abs(l_quantity - b) < 4.5 AND l_quantity > 10.5")
def hits_best_scores(t):
    return hits.best_scores(_parts(t), "expect", 10**4.5, most=10**-10.5).select("query", "subject", "match_rank")


@query(f"WITH iv AS (SELECT query || '/' || subject k, query, subject, q_start s, q_end e FROM {_PARTS}), " + _MERGED + ", c AS (SELECT k, sum(e - s + 1) n FROM mm GROUP BY k) SELECT query, subject, s AS q_start FROM iv JOIN c USING (k) WHERE n >= 15")
def hits_min_length(t):
    return hits.min_length(_parts(t), residues=15).select("query", "subject", "q_start")


@query("""WITH a AS (SELECT DISTINCT l_orderkey q, l_partkey s FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey)), b AS (SELECT DISTINCT l_partkey q, l_orderkey s FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_partkey))
SELECT a.q AS query, a.s AS subject FROM a JOIN b ON a.q = b.s AND a.s = b.q""")
def reciprocal_orthologs(t):
    """Orders and parts that are each other's line of largest quantity."""

    def best(query: str, subject: str) -> DataFrame:
        largest = t("lineitem").groupBy(F.col(query).alias("query")).agg(F.max("l_quantity").alias("l_quantity"))
        return t("lineitem").select(F.col(query).alias("query"), F.col(subject).alias("subject"), "l_quantity").join(largest, ["query", "l_quantity"]).select("query", "subject")

    a, b = best("l_orderkey", "l_partkey"), best("l_partkey", "l_orderkey")
    return hits.reciprocal(a, b)


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08)")
def seqs_without_match(t):
    p = t("lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("subject"))
    return hits.without_match(t("part").select(F.col("p_partkey").alias("name")), p)


@query("SELECT o_orderkey AS name FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def seqs_with_hits(t):
    return hits.with_hits(t("orders").select(F.col("o_orderkey").alias("name")), t("lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("query")))


@query("""WITH h AS (SELECT l_orderkey, p_name, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'old' END db, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linenumber, l_partkey) r FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderkey AS name, 'Similar to ' || p_name || ' (' || db || ':' || l_partkey || ')' AS similar_to FROM orders LEFT JOIN h ON l_orderkey = o_orderkey AND r = 1""")
def description_priority(t):
    first = F.col("l_returnflag") == "N"
    p = t("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("subject"), F.col("l_linenumber").alias("match_rank"), F.when(first, 0).otherwise(1).alias("db_order"), F.when(first, "new").otherwise("old").alias("db"))
    d = t("part").select(F.col("p_partkey").alias("subject"), F.col("p_name").alias("description"))
    return hits.describe(t("orders").select(F.col("o_orderkey").alias("name")), p.join(d.select("subject"), "subject"), d)


_EDGES = "e AS (SELECT c_custkey a, c_custkey + 37 b FROM customer UNION ALL SELECT c_custkey + 37, c_custkey FROM customer)"
_CLUSTERS = f"WITH RECURSIVE {_EDGES}, r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT node, min(other) AS cluster FROM r GROUP BY node)"


def _clusters(t) -> DataFrame:
    e = t("customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 37).alias("b"))
    return hits.clusters(e, checkpoint=pipelines.checkpointed)


@query(f"{_CLUSTERS} SELECT node, cluster FROM c")
def transitive_clusters(t):
    return _clusters(t)


@query(f"{_CLUSTERS}, m AS (SELECT cluster, c_custkey AS name, length(c_name) + CAST(floor(c_acctbal) AS BIGINT) % 100 AS length FROM c JOIN customer ON c_custkey = node), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length DESC, name) n FROM m) SELECT cluster, name, CAST(length AS BIGINT) AS length FROM k WHERE n = 1")
def longest_per_cluster(t):
    m = _clusters(t).join(t("customer"), F.col("node") == F.col("c_custkey"))
    m = m.select("cluster", F.col("c_custkey").alias("name"), (F.length("c_name") + F.floor("c_acctbal") % 100).cast("long").alias("length"))
    return hits.longest_of_each(m)


# Variants.


_MEASURES = f"""WITH a AS (SELECT snv_id, allele, CAST(sum(n) AS DOUBLE) n FROM {_COUNTS} GROUP BY 1, 2), s AS (SELECT snv_id, count(*) alleles, sum(n) r, max(n) m, sum(n * n) q, sum(n * (n - 1)) p, sum(n * (n - 1) * n * (n - 1)) p2 FROM a GROUP BY 1)
SELECT snv_id, round(m / r, 6) maf, round(CASE WHEN alleles = 1 THEN 0 WHEN r >= 4 THEN 1 - p / (r * (r - 1)) - (p * p - p2) / 2 / (r * (r - 1) * (r - 2) * (r - 3)) END, 6) pic,
round(CASE WHEN alleles = 1 THEN 0 WHEN r / 2 < 50 THEN 2 * r / (2 * r - 1) * (1 - q / (r * r)) ELSE r / (r - 1) * (1 - q / (r * r)) END, 6) heterozygosity FROM s"""


@query(_MEASURES)
def snv_measures(t):
    m = variants.measures(_counts(t))
    return m.select("snv_id", *[F.round(c, 6).alias(c) for c in ("maf", "pic", "heterozygosity")])


@query(f"WITH a AS (SELECT snv_id, allele, sum(CASE WHEN rg % 5 IN (1, 2) THEN n ELSE 0 END) n FROM {_COUNTS} GROUP BY 1, 2) SELECT snv_id, round(CASE WHEN sum(n) > 0 THEN max(n) / CAST(sum(n) AS DOUBLE) END, 6) maf FROM a GROUP BY 1")
def snv_maf_by_group(t):
    m = variants.measures(_counts(t).withColumn("g", F.col("rg") % 5), "g", [1, 2])
    return m.select("snv_id", F.round("maf", 6).alias("maf"))


@query(f"""WITH a AS (SELECT l_orderkey snv_id, repeat('A', l_linenumber % 3) || l_returnflag allele, CASE WHEN l_returnflag = 'N' THEN 'INVARIANT' ELSE 'SNP' END kind FROM lineitem), g AS (SELECT snv_id, sum(CASE WHEN kind <> 'INVARIANT' THEN 1 ELSE 0 END) k, max(CASE WHEN kind <> 'INVARIANT' THEN length(allele) END) hi FROM a GROUP BY 1)
SELECT snv_id, CASE WHEN k = 0 THEN 'INVARIANT' WHEN hi = 1 THEN 'SNP' WHEN k > 1 THEN 'COMPLEX' WHEN hi > 1 THEN 'INSERTION' ELSE 'COMPLEX' END AS kind FROM g""")
def snv_kinds(t):
    a = t("lineitem").select(F.col("l_orderkey").alias("snv_id"), F.concat(F.repeat(F.lit("A"), F.col("l_linenumber") % 3), "l_returnflag").alias("allele"), F.when(F.col("l_returnflag") == "N", "INVARIANT").otherwise("SNP").alias("kind"), F.lit("N").alias("ref_allele"))
    return variants.kinds(a)


@query("""WITH r AS (SELECT l_orderkey snv_id, l_returnflag allele, list(l_quantity ORDER BY l_linenumber, l_quantity) q, list_reverse_sort(list_distinct(list(l_quantity))) d, avg(l_quantity * l_quantity) m FROM lineitem GROUP BY 1, 2)
SELECT snv_id, allele, round(d[1] + (coalesce(d[2], q[2], 0) + coalesce(d[3], q[3], 0)) / 4, 6) quality, round(sqrt(m), 6) rms FROM r""")
def allele_quality(t):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("snv_id"), F.col("l_returnflag").alias("allele")).agg(q.alias("q"))
    return g.select("snv_id", "allele", F.round(variants.allele_quality(F.col("q")), 6).alias("quality"), F.round(S.rms(F.col("q")), 6).alias("rms"))


_GROUPED = f"a AS (SELECT snv_id, rg % 5 g, allele, kind, sum(n) n FROM {_COUNTS} WHERE rg % 5 IN (0, 1, 2) GROUP BY 1, 2, 3, 4), v AS (SELECT snv_id, g, NOT (count(*) = 1 OR max(n) / CAST(sum(n) AS DOUBLE) > 0.8) variable FROM a GROUP BY 1, 2)"


@query(f"WITH {_GROUPED}, x AS (SELECT snv_id, bool_or(variable) variable FROM v GROUP BY 1) SELECT o_orderkey AS snv_id, coalesce(variable, false) AS variable FROM orders LEFT JOIN x ON o_orderkey = snv_id")
def variable_in_group(t):
    c = _counts(t).withColumn("g", F.col("rg") % 5)
    return variants.variable_in(t("orders").select(F.col("o_orderkey").alias("snv_id")), c, "g", [0, 1, 2], in_union=False, in_all=False, maf=0.8)


@query(f"WITH {_GROUPED}, x AS (SELECT snv_id, bool_and(NOT variable) invariant FROM v GROUP BY 1) SELECT o_orderkey AS snv_id, coalesce(invariant, false) AS invariant FROM orders LEFT JOIN x ON o_orderkey = snv_id")
def invariant_in_group(t):
    c = _counts(t).withColumn("g", F.col("rg") % 5)
    return variants.invariant_in(t("orders").select(F.col("o_orderkey").alias("snv_id")), c, "g", [0, 1, 2], in_union=False, maf=0.8)


@query(f"SELECT o_orderkey AS snv_id, coalesce(k, 0) < 3 AS min_groups FROM orders LEFT JOIN (SELECT snv_id, count(DISTINCT rg) k FROM {_COUNTS} GROUP BY 1) ON o_orderkey = snv_id")
def min_groups(t):
    return variants.min_groups(t("orders").select(F.col("o_orderkey").alias("snv_id")), _counts(t), 3, "rg")


@query(f"SELECT v.snv_id, (SELECT count(*) FROM {_SNVS} o WHERE o.ref = v.ref AND o.\"start\" BETWEEN v.\"start\" - 300 AND v.\"start\" + 300 AND o.\"start\" <> v.\"start\") AS near FROM {_SNVS} v")
def snvs_in_window(t):
    return variants.neighbours(_snvs(t), 300).select("snv_id", "near")


@query(f"SELECT v.snv_id, EXISTS (SELECT 1 FROM {_SNVS} o WHERE o.ref = v.ref AND o.event_type = 'purchase' AND o.\"start\" BETWEEN v.\"start\" - 60 AND v.\"start\" + 60 AND o.\"start\" <> v.\"start\") AS close_to_snv FROM {_SNVS} v")
def close_to_snv(t):
    return variants.close_to_snv(_snvs(t), 60, F.col("event_type") == "purchase").select("snv_id", "close_to_snv")


@query(f"SELECT snv_id, count(*) OVER (PARTITION BY ref) / 100000.0 > 0.0006 AS high_variable FROM {_SNVS}")
def high_variable_region(t):
    return variants.high_variable_region(_snvs(t), 0.0006).select("snv_id", "high_variable")


@query(f"SELECT snv_id, (\"start\" < 1200 OR \"start\" + 1200 > ref_len) AS close_to_limit FROM {_SNVS}")
def close_to_limit(t):
    return variants.close_to_limit(_snvs(t), 1200).select("snv_id", "close_to_limit")


@query(f"SELECT v.snv_id, EXISTS (SELECT 1 FROM {_SNVS} i WHERE i.ref = v.ref AND i.event_type = 'purchase' AND abs(i.\"start\" + 17 - v.\"start\") < 40) AS close_to_intron FROM {_SNVS} v")
def close_to_intron(t):
    i = _snvs(t).where("event_type = 'purchase'").select("ref", (F.col("start") + 17).alias("position"))
    return variants.close_to_intron(_snvs(t), i, 40).select("snv_id", "close_to_intron")


_SEGMENTS = "SELECT user_id AS ref, k * 1000 AS s, k * 1000 + 600 + 10 * (user_id % 10) AS e FROM (SELECT DISTINCT user_id FROM events), range(0, 100) t(k) WHERE (k + user_id) % 3 = 0"


@query(f"""WITH g AS ({_SEGMENTS}) SELECT v.snv_id, NOT EXISTS (SELECT 1 FROM g WHERE g.ref = v.ref AND v."end" <= g.e - 5 AND v."start" >= g.s AND v."end" >= g.s + 5) AS in_segment FROM {_SNVS} v""")
def in_segment(t):
    users = t("events").select(F.col("user_id").alias("ref")).distinct()
    seg = users.select("ref", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).where((F.col("k") + F.col("ref")) % 3 == 0)
    seg = seg.select("ref", (F.col("k") * 1000).alias("seg_start"), (F.col("k") * 1000 + 600 + 10 * (F.col("ref") % 10)).alias("seg_end"))
    return variants.in_segment(_snvs(t), seg, 5, width=1000).select("snv_id", "in_segment")


@query(f"""WITH c AS (SELECT ref, value, "start", unnest(range(greatest("start" // 100 - 3, 0), greatest("start" // 100 + 4, 0))) k FROM {_SNVS}) SELECT ref, k * 100 AS centre, count(*) AS "values", round(avg(value), 6) AS mean FROM c WHERE abs(k * 100 - "start") <= 250 GROUP BY 1, 2 HAVING count(*) >= 3""")
def moving_window_profile(t):
    p = variants.moving_profile(_snvs(t), "value", 501, 100)
    return p.select("ref", F.col("centre").cast("long").alias("centre"), "values", F.round("mean", 6).alias("mean"))


@query(f"""WITH iv AS (SELECT ref k, "start" s, "start" + 40 e, count(*) n FROM {_SNVS} GROUP BY 1, 2, 3), m0 AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM iv), m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM m0)
SELECT k AS ref, CAST(g AS BIGINT) AS block, min(s) AS "start", max(e) AS "end", CAST(sum(n) AS BIGINT) AS members FROM m1 GROUP BY k, g""")
def snv_blocks(t):
    return variants.blocks(_snvs(t).withColumn("end", F.col("start") + 40))


# Statistics.


@query("SELECT l_returnflag, count(l_quantity) AS count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS average, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def summary_stats(t):
    s = statistics.summary(t("lineitem"), "l_quantity", ["l_returnflag"])
    return s.withColumn("average", F.round("average", 6)).withColumn("variance", F.round("variance", 6))


@query("""WITH v AS (SELECT l_returnflag g, CAST(l_quantity AS BIGINT) * CAST(l_linenumber AS BIGINT) x FROM lineitem), c AS (SELECT g, x, count(*) n FROM v GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY x) upto, lead(x) OVER (PARTITION BY g ORDER BY x) nx FROM c),
t AS (SELECT g, CAST(sum(n) AS BIGINT) total FROM c GROUP BY 1), a AS (SELECT *, total // 2 + total % 2 p2 FROM t), b AS (SELECT *, p2 // 2 + p2 % 2 p1, (p2 + total) // 2 + (p2 + total) % 2 p3 FROM a), j AS (SELECT * FROM u JOIN b USING (g)),
q AS (SELECT g, max(CASE WHEN p1 <= upto AND p1 > upto - n THEN CASE WHEN p1 = upto THEN (x + coalesce(nx, x)) // 2 ELSE x END END) q1, max(CASE WHEN p2 <= upto AND p2 > upto - n THEN CASE WHEN p2 = upto THEN (x + coalesce(nx, x)) // 2 ELSE x END END) q2, max(CASE WHEN p3 <= upto AND p3 > upto - n THEN CASE WHEN p3 = upto THEN (x + coalesce(nx, x)) // 2 ELSE x END END) q3 FROM j GROUP BY g)
SELECT g, q1 AS quartile_1, q2 AS median, q3 AS quartile_3, q3 - q1 AS iqr, q1 - CAST(floor((q3 - q1) * 1.5 + 0.5) AS BIGINT) AS low_limit, q3 + CAST(floor((q3 - q1) * 1.5 + 0.5) AS BIGINT) AS high_limit FROM q""")
def quartiles_outliers(t):
    v = t("lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity").cast("long") * F.col("l_linenumber")).alias("x"))
    return statistics.quartiles(v, "x", ["g"])


@query("""WITH r AS (SELECT min(l_quantity) lo, (max(l_quantity) - min(l_quantity)) / 20 w FROM lineitem), b AS (SELECT least(CAST(floor((l_quantity - lo) / w) AS BIGINT), 19) bin FROM lineitem, r), c AS (SELECT bin, count(*) n FROM b GROUP BY 1)
SELECT k AS bin, round(lo + k * w, 6) AS left_edge, round(lo + (k + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n FROM range(0, 20) t(k) CROSS JOIN r LEFT JOIN c ON bin = k""")
def histogram_equal_width(t):
    h = statistics.histogram(t("lineitem"), "l_quantity", 20)
    return h.select("bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), F.col("n").cast("long").alias("n"))


@query("WITH v AS (SELECT CAST(l_quantity AS BIGINT) x FROM lineitem), c AS (SELECT least((x - 1) // 5, 9) bin, count(*) n FROM v GROUP BY 1) SELECT k AS bin, 1.0 + 5 * k AS left_edge, 6.0 + 5 * k AS right_edge, coalesce(n, 0) AS n FROM range(0, 10) t(k) LEFT JOIN c ON bin = k")
def int_distribution(t):
    d = statistics.distribution(t("lineitem").select(F.col("l_quantity").cast("long").alias("x")), "x", bins=10)
    return d.withColumn("n", F.col("n").cast("long"))


@query("SELECT l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1")
def boxplot_rows(t):
    b = statistics.boxplot(t("lineitem"), "l_linenumber", "l_quantity")
    return b.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT unnest([5.0, 25.0, 50.0, 95.0]) AS percent, unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.95])) AS value FROM lineitem")
def percentiles(t):
    return statistics.percentiles(t("lineitem"), "l_extendedprice", [5, 25, 50, 95])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def annotation_stats_cube(t):
    return annotation.cube_counts(t("lineitem"), "l_returnflag", "l_linestatus")


# Mapped reads.


@query(f"""WITH i AS (SELECT ref, "start" s, "start" + 199 e FROM {_SNVS}), ev AS (SELECT ref, s p, 1 d FROM i UNION ALL SELECT ref, e + 1, -1 FROM i), g AS (SELECT ref, p, sum(d) d FROM ev GROUP BY 1, 2), r AS (SELECT ref, p, sum(d) OVER w depth, lead(p) OVER w nx FROM g WINDOW w AS (PARTITION BY ref ORDER BY p)), c AS (SELECT CAST(depth AS BIGINT) depth, sum(nx - p) bases FROM r WHERE depth > 0 GROUP BY 1)
SELECT depth, CAST(bases AS BIGINT) AS bases FROM c UNION ALL SELECT 0, CAST((SELECT 200000 * count(DISTINCT ref) FROM i) - sum(bases) AS BIGINT) FROM c""")
def coverage_depth(t):
    seg = _snvs(t).select("ref", "start", (F.col("start") + 199).alias("end"))
    lengths = seg.select("ref").distinct().withColumn("length", F.lit(200_000).cast("long"))
    return mappings.coverage(seg, lengths)


@query("SELECT event_type, count(*) AS reads, CAST(sum(CAST(event_id % 4096 & 4 = 0 AS INT)) AS BIGINT) AS mapped, CAST(sum(CAST(event_id % 4096 & 2 <> 0 AS INT)) AS BIGINT) AS proper_pairs, CAST(sum(CAST(event_id % 4096 & 256 <> 0 AS INT)) AS BIGINT) AS secondary, CAST(sum(CAST(event_id % 4096 & 512 <> 0 AS INT)) AS BIGINT) AS qc_failed, CAST(sum(CAST(event_id % 4096 & 1024 <> 0 AS INT)) AS BIGINT) AS duplicates, CAST(sum(CAST(event_id % 4096 & 16 <> 0 AS INT)) AS BIGINT) AS reverse FROM events GROUP BY 1")
def mapping_stats_flags(t):
    return mappings.flag_statistics(t("events").withColumn("flag", (F.col("event_id") % 4096).cast("int")), by="event_type")


@query("SELECT event_type, user_id % 60 AS value, count(*) AS n FROM events GROUP BY 1, 2")
def mapq_by_group(t):
    return mappings.by_group(t("events").withColumn("mapq", F.col("user_id") % 60), "mapq", "event_type")


@query("SELECT event_id, CAST(CASE WHEN (event_id & 1) = 0 THEN event_id & 16191 ELSE event_id & 16383 END AS BIGINT) AS flag FROM events")
def fix_flags(t):
    return t("events").select("event_id", A.fix_flag(F.col("event_id")).cast("long").alias("flag"))


@query("SELECT l_orderkey, s_name, n_name, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def read_group_join(t):
    groups = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("rg"), F.lit("illumina").alias("pl"), F.col("n_name").alias("lb"), F.col("s_name").alias("sm"))
    out = mappings.with_read_groups(t("lineitem").withColumnRenamed("l_suppkey", "rg"), groups)
    return out.where("sm is not null").select("l_orderkey", F.col("sm").alias("s_name"), F.col("lb").alias("n_name"), "l_linenumber")


# Annotation, maps and names.


@query("""SELECT event_id, CASE WHEN s IS NULL THEN 'unknown' WHEN x < s THEN CASE WHEN d = '-' THEN 'utr3' ELSE 'utr5' END WHEN x > e THEN CASE WHEN d = '-' THEN 'utr5' ELSE 'utr3' END ELSE 'orf' END AS location
FROM (SELECT event_id, user_id, (event_id * 7919) % 1000 x FROM events) LEFT JOIN (SELECT DISTINCT user_id u, 200 + user_id s, 700 + user_id e, CASE WHEN user_id % 2 = 0 THEN '-' ELSE '+' END d FROM events) ON u = user_id""")
def orf_locations(t):
    e = t("events")
    f = e.select("event_id", F.col("user_id").alias("name"), ((F.col("event_id") * 7919) % 1000).alias("start"))
    o = e.select(F.col("user_id").alias("name"), (200 + F.col("user_id")).alias("start"), (700 + F.col("user_id")).alias("end"), F.when(F.col("user_id") % 2 == 0, "-").otherwise("+").alias("strand")).distinct()
    return annotation.orf_location(f, o).select("event_id", "location")


@query("SELECT event_type AS ftype, count(*) AS features, count(DISTINCT user_id) AS sequences FROM events GROUP BY 1")
def feature_counts(t):
    return annotation.feature_counts(t("events").select(F.col("user_id").alias("name"), F.col("event_type").alias("ftype")))


@query("WITH f AS (SELECT k frag, k * 1000 a0, k * 1000 + 999 a1, 500000 - k * 2000 b0, 500000 - k * 2000 - 999 b1 FROM range(0, 100) t(k)) SELECT snv_id, frag, b0 - (\"start\" - a0) AS target_position, '-' AS strand FROM " + _SNVS + " JOIN f ON \"start\" BETWEEN a0 AND a1")
def transform_positions(t):
    spark = t("region").sparkSession
    k = spark.range(100).withColumnRenamed("id", "frag")
    frags = k.select("frag", F.lit("cdna").alias("molecule"), (F.col("frag") * 1000).alias("start"), (F.col("frag") * 1000 + 999).alias("end")).unionByName(k.select("frag", F.lit("genome").alias("molecule"), (500_000 - F.col("frag") * 2000).alias("start"), (500_000 - F.col("frag") * 2000 - 999).alias("end")))
    p = _snvs(t).select("snv_id", F.col("start").alias("position"))
    return annotation.transform_positions(p, frags, "cdna", "genome", 1000).select("snv_id", "frag", "target_position", "strand")


@query("""WITH b AS (SELECT p_brand AS name, p_partkey, p_type, p_name FROM part), f AS (SELECT name, p_type, row_number() OVER (PARTITION BY name ORDER BY p_partkey) r FROM b)
SELECT f.name, f.p_type AS type, n AS aliases FROM f JOIN (SELECT name, count(DISTINCT p_name) n FROM b GROUP BY 1) USING (name) WHERE r = 1""")
def marker_upsert(t):
    p = t("part")
    first = p.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("type"))
    a = first.select(F.col("p_brand").alias("name"), F.array().cast("array<string>").alias("alias"), "type")
    b = p.select(F.col("p_brand").alias("name"), F.array("p_name").alias("alias"), F.col("p_type").alias("type"))
    return maps.upsert_markers(a, b, ["type"]).select("name", "type", F.size("alias").cast("long").alias("aliases"))


@query("SELECT s_nationkey AS map_set, s_suppkey % 7 AS map, min(s_acctbal) AS \"start\", max(s_acctbal) AS \"end\", count(*) AS features FROM supplier GROUP BY 1, 2")
def genetic_map_bounds(t):
    return maps.map_bounds(t("supplier").select(F.col("s_nationkey").alias("map_set"), (F.col("s_suppkey") % 7).alias("map"), F.col("s_acctbal").alias("start"), F.col("s_acctbal").alias("end")))


@query("SELECT x.s_nationkey AS marker, x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
def correspondences(t):
    return maps.correspondences(t("supplier").select(F.col("s_nationkey").alias("marker"), F.col("s_suppkey").alias("location_id")))


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_name) AS number FROM customer")
def allocate_names(t):
    c = t("customer").select(F.col("c_name").alias("name"))
    known = c.limit(0).select("name", F.lit(0).cast("long").alias("number"))
    return maps.allocate_names(c, known, "N").select("name", F.col("number").cast("long").alias("number"))


@query("""SELECT c_name AS name, c_custkey AS number FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_name, (SELECT coalesce(max(c_custkey), 0) FROM customer WHERE c_custkey % 2 = 1) + row_number() OVER (ORDER BY c_name) FROM customer WHERE c_custkey % 2 = 0""")
def allocate_all_names(t):
    """All customers: the odd ones are known by their keys, the others get new numbers."""
    c = t("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("number"))
    return maps.allocate_names(c.select("name"), c.where("number % 2 = 1"), "N").select("name", F.col("number").cast("long").alias("number"))


@query("(SELECT DISTINCT o_custkey AS x FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def symmetric_difference(t):
    o = t("orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("x"))
    return hits.symmetric_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority LIKE '1%'"), "x")


# Names, types and codes.

_CODES = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN repeat('Z', p_size % 4 + 1) WHEN 1 THEN chr(65 + p_size % 26) || 'Z' WHEN 2 THEN repeat('9', p_size % 4 + 1) WHEN 3 THEN 'AZ' || repeat('9', p_size % 3 + 1) ELSE 'B' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') END code FROM part)"
_STEP = "CASE WHEN rtrim(l, 'Z') = '' THEN repeat('A', length(l) + 1) ELSE left(rtrim(l, 'Z'), length(rtrim(l, 'Z')) - 1) || chr(ascii(right(rtrim(l, 'Z'), 1)) + 1) || repeat('A', length(l) - length(rtrim(l, 'Z'))) END"


@query(f"""WITH c AS (SELECT p_partkey, code, regexp_replace(code, '[0-9]', '', 'g') l, regexp_replace(code, '[^0-9]', '', 'g') d FROM {_CODES})
SELECT p_partkey, code, CASE WHEN d = '' THEN CASE WHEN l = repeat('Z', length(l)) THEN repeat('0', length(code) + 1) ELSE {_STEP} END
WHEN d = repeat('9', length(d)) THEN CASE WHEN l = '' THEN rpad('A', CAST(length(code) AS INT), '0') ELSE rpad({_STEP}, CAST(length(code) AS INT), '0') END
ELSE l || lpad(CAST(CAST(d AS BIGINT) + 1 AS VARCHAR), CAST(length(d) AS INT), '0') END AS next_code FROM c""")
def next_codes(t):
    k, n = F.col("p_partkey"), F.col("p_size")
    code = F.when(k % 5 == 0, F.repeat(F.lit("Z"), n % 4 + 1)).when(k % 5 == 1, F.concat(F.char(65 + n % 26), F.lit("Z"))).when(k % 5 == 2, F.repeat(F.lit("9"), n % 4 + 1))
    code = code.when(k % 5 == 3, F.concat(F.lit("AZ"), F.repeat(F.lit("9"), n % 3 + 1))).otherwise(F.concat(F.lit("B"), F.lpad((k % 100).cast("string"), 3, "0")))
    return t("part").select("p_partkey", code.alias("code")).withColumn("next_code", maps.next_code(F.col("code")))


_TYPE_NAMES = ("ssr", "SNP-caps", "trait", "rapds", "Est-SSR", "whatever", "rflp", "scar", "unknown", "aflp")


@query(f"""WITH m AS (SELECT p_partkey, ({list(_TYPE_NAMES)})[p_size % 10 + 1] ty FROM part)
SELECT p_partkey, CASE lower(ty) WHEN 'ssr' THEN 'microsatellite' WHEN 'est-ssr' THEN 'microsatellite' WHEN 'snp-caps' THEN 'SNP' WHEN 'scar' THEN 'SNP' WHEN 'trait' THEN 'morphological' WHEN 'rapds' THEN 'rapd' WHEN 'rflp' THEN 'RFLP_fragment' WHEN 'unknown' THEN 'sequence_feature' ELSE ty END AS type,
CASE lower(ty) WHEN 'ssr' THEN 'SO:0000289' WHEN 'est-ssr' THEN 'SO:0000289' WHEN 'snp-caps' THEN 'SO:0000694' WHEN 'scar' THEN 'SO:0000694' WHEN 'unknown' THEN 'SO:0000110' END AS sofa FROM m""")
def marker_types(t):
    kinds = F.array(*[F.lit(x) for x in _TYPE_NAMES])
    return maps.standard_types(t("part").select("p_partkey", F.get(kinds, F.col("p_size") % 10).alias("type")))


# Mapped reads and variant calling: reads of ten bases on 25 references of 120.

_READS = """(SELECT l_orderkey * 10 + l_linenumber qname, l_suppkey % 25 rname, l_partkey % 100 pos, substr(repeat('ACGT', 40), CAST(l_partkey % 100 + 1 + CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS INT), 10) seq,
CAST(l_quantity AS INT) q, CAST(l_orderkey % 40 AS INT) mapq, CASE WHEN l_returnflag = 'N' THEN '454' ELSE 'illumina' END pl FROM lineitem)"""


def _alignments(t) -> DataFrame:
    pos = (F.col("l_partkey") % 100).cast("int")
    shift = F.when(F.col("l_linenumber") % 5 == 0, 1).otherwise(0)
    return t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qname"), F.lit(0).alias("flag"), (F.col("l_suppkey") % 25).cast("string").alias("rname"), pos.alias("pos"), F.lit("10M").alias("cigar"),
        F.substring(F.repeat(F.lit("ACGT"), F.lit(40)), pos + 1 + shift, F.lit(10)).alias("seq"), F.array_repeat(F.col("l_quantity").cast("int"), 10).alias("qual"), (F.col("l_orderkey") % 40).cast("int").alias("mapq"),
        F.when(F.col("l_returnflag") == "N", "454").otherwise("illumina").alias("pl"), F.col("l_returnflag").alias("rg"),
    )


def _references(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").cast("string").alias("name"), F.repeat(F.lit("ACGT"), F.lit(30)).alias("seq"))


@query(f"""WITH b AS (SELECT qname, rname, pos rp, pos + k p, substr(seq, CAST(k + 1 AS INT), 1) allele, substr(repeat('ACGT', 30), CAST(pos + k + 1 AS INT), 1) r, q FROM {_READS}, range(0, 10) x(k) WHERE mapq >= 15 AND NOT (pl = '454' AND (2 > k OR k > 9 - 1))),
n AS (SELECT *, row_number() OVER (PARTITION BY rname, p, allele ORDER BY rp, qname) k FROM b),
a AS (SELECT rname, p, r, allele, count(*) reads, list_reverse_sort(list_distinct(list(q))) d, max(CASE WHEN k = 2 THEN q END) q2, max(CASE WHEN k = 3 THEN q END) q3 FROM n GROUP BY 1, 2, 3, 4),
g AS (SELECT rname, p, CASE WHEN allele = r THEN 'INVARIANT' ELSE 'SNP' END kind, allele, reads, d[1] + (coalesce(d[2], q2, 0) + coalesce(d[3], q3, 0)) / 4.0 quality FROM a),
m AS (SELECT *, max(reads) OVER w / CAST(sum(reads) OVER w AS DOUBLE) maf FROM g WHERE quality >= 45 WINDOW w AS (PARTITION BY rname, p)),
f AS (SELECT *, count(*) OVER w n, max(CASE WHEN kind <> 'INVARIANT' THEN 1 ELSE 0 END) OVER w v FROM m WHERE maf <= 0.9 AND reads >= 2 WINDOW w AS (PARTITION BY rname, p))
SELECT CAST(rname AS VARCHAR) rname, CAST(p AS BIGINT) pos, allele, kind, reads, CAST(quality AS DOUBLE) quality FROM f WHERE n > 1 OR v = 1""")
def call_variants(t):
    out = mappings.call_variants(_alignments(t), _references(t), 45, 15, 2, max_maf=0.9, edges={"454": (2, 1)}, checkpoint=pipelines.checkpointed)
    return out.select("rname", F.col("pos").cast("long").alias("pos"), "allele", "kind", "reads", "quality")


@query(f"""WITH b AS (SELECT rname, pos + k p, substr(seq, CAST(k + 1 AS INT), 1) allele, q, mapq FROM {_READS}, range(0, 10) x(k) WHERE mapq >= 15)
SELECT CAST(rname AS VARCHAR) AS rname, CAST(p AS BIGINT) AS pos, round(sqrt(avg(q * q)), 6) AS quality, round(sqrt(avg(mapq * mapq)), 6) AS mapping_quality FROM b GROUP BY 1, 2""")
def snv_summary(t):
    rows = mappings.read_alleles(_alignments(t), _references(t)).withColumn("snv_id", F.struct("rname", "pos"))
    _, quality = variants.summarised(rows)
    return quality.select("snv_id.rname", F.col("snv_id.pos").cast("long").alias("pos"), F.round("quality", 6).alias("quality"), F.round("mapping_quality", 6).alias("mapping_quality"))


@query("""SELECT event_id, CAST(50 + event_id % 7 + 3 + 20 AS BIGINT) AS read_bases, CAST(10 + 50 + event_id % 5 + 1 AS BIGINT) AS last_match, CAST(50 + event_id % 7 + 3 AS BIGINT) AS last_read
FROM events""")
def cigar_places(t):
    """Reads of 50M, an insertion, a deletion and 20M at place 10."""
    k = F.col("event_id")
    cigar = F.concat(F.lit("50M"), (k % 7 + 3).cast("string"), F.lit("I"), (k % 5 + 1).cast("string"), F.lit("D20M"))
    s = A.cigar_segments(F.lit(10), cigar)
    return t("events").select("event_id", A.cigar_sum(cigar, "MIS").cast("long").alias("read_bases"), F.element_at(s, -1)["ref_start"].cast("long").alias("last_match"), F.element_at(s, -1)["read_start"].cast("long").alias("last_read"))


# Variant filters by name, and what variant files say of variants.

_NEAR = f"""s AS (SELECT * FROM {_SNVS}), pl AS (SELECT ref, "start", count(*) n FROM s GROUP BY 1, 2),
near AS (SELECT ref, "start", sum(n) OVER (PARTITION BY ref ORDER BY "start" RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) - n k FROM pl), tot AS (SELECT ref, count(*) n FROM s GROUP BY 1)"""


@query(f"""WITH {_NEAR}, f AS (SELECT snv_id, k > 0 a, tot.n / 100000.0 > 0.00006 b, s."start" < 500 OR s."start" + 500 > 100000 c, s.ref NOT IN (1, 2, 3) d FROM s JOIN near USING (ref, "start") JOIN tot USING (ref))
SELECT snv_id, CASE WHEN a OR b OR c OR d THEN concat_ws(';', CASE WHEN a THEN 'CS60' END, CASE WHEN b THEN 'HVR0' END, CASE WHEN c THEN 'CL500' END, CASE WHEN d THEN 'RNL' END) ELSE 'PASS' END AS filters FROM f""")
def filter_snvs(t):
    chosen = [
        selection.standard("close_to_snv", (60,), distance=60), selection.standard("high_variable_reg", (0.00006,), most=0.00006), selection.standard("close_to_limit", (500,), distance=500),
        selection.standard("ref_not_in_list", (), names=[1, 2, 3], invert=True),
    ]
    return selection.filter_snvs(_snvs(t), chosen).select("snv_id", "filters")


@query(f"""WITH a AS (SELECT snv_id, allele, kind, sum(n) n FROM {_COUNTS} GROUP BY 1, 2, 3), m AS (SELECT snv_id, max(n) / CAST(sum(n) AS DOUBLE) maf FROM (SELECT snv_id, allele, sum(n) n FROM a GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT snv_id, count(DISTINCT rg) k FROM {_COUNTS} GROUP BY 1)
SELECT snv_id, CASE WHEN maf > 0.7 OR k < 3 THEN concat_ws(';', CASE WHEN maf > 0.7 THEN 'MAF1' END, CASE WHEN k < 3 THEN 'MR3' END) ELSE 'PASS' END AS filters FROM m JOIN g USING (snv_id)""")
def filter_snvs_by_counts(t):
    c = _counts(t)
    chosen = [selection.standard("maf", (0.7,), counts=c, frequency=0.7), selection.standard("min_groups", (3, "read_groups"), counts=c, least=3, group="rg")]
    return selection.filter_snvs(c.select("snv_id").distinct(), chosen).select("snv_id", "filters")


_NUMBERED = f"n AS (SELECT snv_id, allele, CASE WHEN allele = min(allele) OVER (PARTITION BY snv_id) THEN 0 ELSE dense_rank() OVER (PARTITION BY snv_id ORDER BY allele) - 1 END i, n, rg FROM {_COUNTS})"


@query(f"""WITH {_NUMBERED}, g AS (SELECT snv_id, i, sum(n) reads, count(DISTINCT rg) k FROM n WHERE n > 0 GROUP BY 1, 2), s AS (SELECT snv_id, sum(reads) a, sum(k) b, max(CASE WHEN i = 0 THEN k END) z FROM g GROUP BY 1)
SELECT snv_id, concat_ws(';', 'RC=' || string_agg(CASE WHEN i > 0 THEN CAST(reads AS VARCHAR) END, ',' ORDER BY i), 'AF=' || string_agg(CASE WHEN i > 0 THEN printf('%.1f', floor(reads * 10.0 / a + 0.5 + 1e-9) / 10) END, ',' ORDER BY i),
'GC=' || string_agg(CAST(k AS VARCHAR), ',' ORDER BY i), 'GP=' || printf('%.2f', floor((1 - z / CAST(max(b) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100)) AS info FROM g JOIN s USING (snv_id) GROUP BY snv_id, z""")
def vcf_info(t):
    c = _counts(t)
    from pyspark.sql import Window

    order = c.select("snv_id", "allele").distinct().withColumn("number", F.row_number().over(Window.partitionBy("snv_id").orderBy("allele")) - 1)
    return variants.info(c, order)


@query(f"WITH a AS (SELECT snv_id, allele, sum(n) n FROM {_COUNTS} GROUP BY 1, 2) SELECT snv_id, first(allele ORDER BY n DESC, allele) AS major, string_agg(allele, '>' ORDER BY n DESC, allele) AS alleles FROM a GROUP BY 1")
def alleles_by_reads(t):
    c = _counts(t)
    return variants.major_allele(c).join(variants.alleles_by_reads(c).select("snv_id", F.array_join("alleles", ">").alias("alleles")), "snv_id")


@query(f"""WITH a AS (SELECT snv_id, allele, sum(n) n FROM {_COUNTS} GROUP BY 1, 2), m AS (SELECT max(n) / CAST(sum(n) AS DOUBLE) v FROM a GROUP BY snv_id), r AS (SELECT min(v) lo, max(v) hi FROM m), b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 20)) AS BIGINT), 19) bin, count(*) n FROM m, r GROUP BY 1)
SELECT x.k AS bin, coalesce(n, 0) AS n FROM range(0, 20) x(k) LEFT JOIN b ON b.bin = x.k""")
def maf_distribution(t):
    return variants.measure_distribution(variants.measures(_counts(t)), "maf").select("bin", F.col("n").cast("long").alias("n"))


@query("""WITH p AS (SELECT l_orderkey q, l_partkey s, 90 + 100 * l_discount sim, CAST(l_quantity AS BIGINT) a, CAST(l_quantity AS BIGINT) + l_linenumber * 3 b FROM lineitem WHERE 90 + 100 * l_discount >= 95),
r AS (SELECT *, max(b) OVER (PARTITION BY q, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM p), c AS (SELECT q, s, sum(greatest(b - greatest(a, coalesce(m + 1, a)) + 1, 0)) n FROM r GROUP BY 1, 2)
SELECT p.q AS query, p.s AS subject, p.a AS q_start FROM p JOIN c USING (q, s) WHERE n >= 10""")
def filter_hits(t):
    return selection.filter_hits(_parts(t), [{"kind": "score_threshold", "score": "similarity", "least": 95}, {"kind": "min_length", "residues": 10}]).select("query", "subject", "q_start")


# Annotation files as lines.


@query("SELECT n_name || chr(9) || s_name || chr(9) || string_agg(p, ',' ORDER BY p) AS line FROM (SELECT DISTINCT s_name, n_name, CAST(l_partkey AS VARCHAR) p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY s_name, n_name")
def ortholog_lines(t):
    n = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = t("lineitem").join(n, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "n_name", F.col("l_partkey").cast("string").alias("p"))
    names = pairs.groupBy(F.col("s_name").alias("name"), "n_name").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return writers.ortholog_lines(names.select("name", F.create_map("n_name", "p").alias("orthologs")))


@query("""WITH f AS (SELECT event_id, user_id, (event_id * 7919) % 1000 a, event_id % 30 + 5 l, repeat('AT', CAST(event_id % 3 + 1 AS INT)) u FROM events)
SELECT user_id || chr(9) || (a + 1) || chr(9) || (a + l + 1) || chr(9) || (l + 1) || chr(9) || (event_id % 50) || chr(9) || 'di' || chr(9) || u || chr(9) || CAST(floor((l + 1) / length(u)) AS BIGINT) AS line FROM f""")
def ssr_lines(t):
    a = (F.col("event_id") * 7919) % 1000
    f = t("events").select(F.col("user_id").alias("name"), a.alias("start"), (a + F.col("event_id") % 30 + 5).alias("end"), (F.col("event_id") % 50).alias("score"), F.lit("di").alias("kind"), F.repeat(F.lit("AT"), (F.col("event_id") % 3 + 1).cast("int")).alias("unit"))
    return writers.ssr_lines(f)


@query("SELECT '>' || event_id || '_orf_pep start=' || (event_id % 90 + 1) || ' end=' || (event_id % 90 + 301) || ' strand=' || CASE WHEN event_id % 2 = 0 THEN 'forward' ELSE 'reverse' END || chr(10) || upper(event_type) AS line FROM events")
def orf_lines(t):
    k = F.col("event_id")
    f = t("events").select(k.alias("name"), (k % 90).alias("start"), (k % 90 + 300).alias("end"), F.when(k % 2 == 0, "forward").otherwise("reverse").alias("strand"), F.upper("event_type").alias("pep"), F.upper("event_type").alias("dna"))
    return writers.orf_lines(f, "pep")


_CHOSEN = "WITH s AS (SELECT doc_id, text, length(text) n, CAST((doc_id * 31) % greatest(length(text), 1) AS INT) a FROM documents)"


def _chosen(t) -> DataFrame:
    at = ((F.col("doc_id") * 31) % F.greatest(F.length("text"), F.lit(1))).cast("int")
    return t("documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq"), at.alias("start"), F.lit("T").alias("ref"), F.array(F.lit("C"), F.lit("A")).alias("alleles"))


@query(f"""{_CHOSEN}
SELECT doc_id || '_' || (a + 1) || ',SNP,' || substr(text, greatest(n + a - 60, 0) * CAST(a < 60 AS INT) + greatest(a - 60, 0) + 1, CASE WHEN a >= 60 THEN 60 ELSE greatest(a - greatest(n + a - 60, 0), 0) END) || '[A/C/T]' || substr(text, a + 2, 60) AS line FROM s""")
def illumina_lines_by_slices(t):
    """Left flanks that would begin before a text count from its end."""
    return writers.illumina_lines(_chosen(t))


@query(f"""{_CHOSEN}
SELECT doc_id || '_' || (a + 1) || ',SNP,' || CASE WHEN a >= 60 THEN substr(text, a - 59, 60) ELSE substr(text, 1, a) END || '[A/C/T]' || substr(text, a + 2, 60) AS line FROM s""")
def illumina_lines(t):
    d = _chosen(t)
    return writers.illumina_lines(d, short=True)


@query("""WITH f AS (SELECT event_id, user_id, event_type, (event_id * 7919) % 1000 a FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, a, event_id) i, row_number() OVER (PARTITION BY event_type, user_id ORDER BY a, event_id) j FROM f),
r AS (SELECT user_id, event_type, a, CASE WHEN event_type = 'click' THEN 'snv' || i ELSE user_id || '.' || event_type || j END nm FROM k)
SELECT CAST(user_id AS VARCHAR) AS seqid, CASE WHEN event_type = 'click' THEN 'SNV' ELSE event_type END AS type, a + 1 AS "start", nm AS name FROM r
UNION ALL SELECT CAST(u AS VARCHAR), 'region', 1, CAST(u AS VARCHAR) FROM (SELECT DISTINCT user_id u FROM events)""")
def gff_features(t):
    e = t("events")
    a = (F.col("event_id") * 7919) % 1000
    f = e.select(F.col("user_id").alias("name"), F.when(F.col("event_type") == "click", "snv").otherwise(F.col("event_type")).alias("ftype"), a.alias("start"), (a + F.col("event_id") / 1e9).alias("end"))
    out = writers.gff_features(e.select(F.col("user_id").alias("name"), F.lit("ACGT").alias("seq")).distinct(), f)
    return out.select(F.col("seqid").cast("string").alias("seqid"), "type", "start", F.col("attributes")["name"][0].alias("name"))


@query(_IV_ONCE + _MERGED + " SELECT k, s AS \"start\", e AS \"end\" FROM mm")
def merge_intervals_by_bins(t):
    return intervals.merge(_intervals(t), "k", bin_width=16)
