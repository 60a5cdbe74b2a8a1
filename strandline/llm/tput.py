"""Ranked lexical search by TPUT over term-partitioned posting lists.

Documents are read once: of each, the number of its terms and those that some query asks for.
A posting is a document's part of the score under one term, before the term's weight, so a
term's list has one order for all queries.  Lists are dealt by term, long ones in several parts, and
stored in descending order.

1. Heads.  The first k postings of every list give partial scores.  The k documents of largest partial score are
   looked up; the least of their scores is a lower bound of a query's k-th score.
2. Uniform threshold.  One threshold holds for all lists of a query: the largest one for which postings below it, or, where
   a list's head is below it, that head, add to less than the bound.  Every list is read down to it.  What is
   read is dealt by document and added up; a document whose partial score, with what
   its unread lists can add at most, is below the bound goes.  The k-th partial score raises the bound once more.
3. Lookups.  The exact scores of the documents that are left are added up from all lists of their query.

Queries are answered in blocks of so many that every task can hold their terms and thresholds.

A term is a maximal run of characters other than ASCII ones that are neither letters nor
digits; A-Z are taken as a-z.  Terms are told apart by 64-bit hashes.  Null texts have no terms, and queries without terms have no results.
Every row is a document: rows that repeat an id are ranked each.  Rows that
repeat a query's id and text are one query; an id with two texts is two queries.  Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

#: Postings in one part of a list, about.
PART = 50_000
#: Terms of all queries that every task holds at most; with more, postings meet them in a join.
HELD_TERMS = 1_000_000
#: Postings that are added up at a time.
ADDED = 50_000
#: Partial scores that a task keeps for its own bounds.
BEST = 4_000_000
#: Bytes between terms.
_GAPS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def terms_of(rows: DataFrame, shape: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``rows`` (..., t) with, for t: row (a number of its own), n (all terms), and its distinct terms with their counts; of ``wanted`` terms only, if given.

    ``rows`` must give the same rows when a task is repeated, as files and stored tables do.
    """
    common.small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c != "t"]

    def count(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column("t").to_pylist()
            h, n = common.word_hashes(texts, fold_case=True, gaps=_GAPS)
            owner = np.repeat(np.arange(len(texts)), n)
            key = h.view(np.int64)
            vocabulary = np.unique(key) if wanted is None else wanted
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
                hit = vocabulary[at] == key
                pair, tf = np.unique(owner[hit] * len(vocabulary) + at[hit], return_counts=True)
                owner, term = pair // len(vocabulary), vocabulary[pair % len(vocabulary)]
            else:
                owner, term, tf = owner[:0], key[:0], key[:0]
            ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
            cols = [b.column(c) for c in names] + [pa.array(row + np.arange(len(texts))), pa.array(n)]
            cols += [pa.ListArray.from_arrays(ends, pa.array(term, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "row", "n", "terms", "tfs"])
            row += len(texts)

    return rows.mapInArrow(count, f"{shape}, row long, n long, terms array<long>, tfs array<long>")


def _body(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t")


def top(rows: DataFrame, k: int, key: str, *order: Column) -> DataFrame:
    """The first k rows of each key, ``r`` from 1; tasks keep no more than k of a key before rows are dealt."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= k)


def posting_lists(found: DataFrame, weights: DataFrame, documents: int, length: int) -> DataFrame:
    """Stored postings (term, part, row, impact): lists in parts, each in descending order."""
    each = found.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("v")).select("row", "n", F.col("v.terms").alias("term"), F.col("v.tfs").alias("tf"))
    m = F.expr(f"50 + (50 * n * {documents}L) div {length}L")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    sized = weights.select("term", F.ceil(F.col("df") / PART).cast("int").alias("parts"))
    each = each.join(common.hinted(sized), "term")
    each = each.withColumn("m", m).select("term", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", impact.alias("impact"))
    return common.stored(each.repartition(F.col("term"), F.col("part")).sortWithinPartitions("term", "part", F.desc("impact"), "row"), "lists")


def met(lists: DataFrame, asks: DataFrame) -> DataFrame:
    """``lists`` joined with what queries ask of them, by term."""
    if common.at_most(asks, common.BROADCAST_ROWS):
        return lists.join(common.hinted(asks), "term")
    return common.salted_join(lists, asks, "term", "row")


def _score() -> Column:
    return F.sum(F.col("w") * F.col("impact")).alias("score")


def looked_up(lists: DataFrame, pairs: DataFrame, asks: DataFrame) -> DataFrame:
    """Stored exact scores of pairs (q, row), from all lists of the query."""
    look = common.stored(pairs.select("q", "row").join(common.hinted(asks.select("q", "term", "w")), "q"), "lookups")
    exact = lists.select("term", "row", "impact").join(common.hinted(look), ["term", "row"])
    return common.stored(exact.groupBy("q", "row").agg(_score()), "exact")


def thresholds(asks: DataFrame, bound: DataFrame) -> DataFrame:
    """``asks`` (q, term, w, most) with the query's ``bound``, its postings' least part ``least``, and the most that an unread posting adds, ``cap``.

    With the heads in ascending order, those before a place count whole and all others as u = least - 1; the first place whose head is above u gives it.
    """
    rows = asks.join(common.hinted(bound), "q", "left").na.fill(0, ["bound"])
    w = Window.partitionBy("q")
    up = w.orderBy("most", "term")
    rows = rows.withColumn("_before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_rest", F.count("*").over(w) - F.row_number().over(up) + 1)
    u = F.when(F.col("_before") + F.col("_rest") * F.col("most") > F.col("bound") - 1, F.expr("(bound - 1 - _before) div _rest"))
    rows = rows.withColumn("least", F.greatest(F.coalesce(F.min(u).over(w), F.lit(0)), F.lit(0)) + 1)
    return rows.drop("_before", "_rest").withColumn("cap", F.least(F.col("most"), F.col("least") - 1))


def partial_scores(lists: DataFrame, cut: DataFrame, k: int) -> DataFrame:
    """Stored (q, row, score, upper) of documents that may reach their query's bound, from the postings at or above the thresholds ``cut``.

    ``cut`` is at most ``common.BROADCAST_ROWS`` rows.  The k-th partial score that a task has seen raises its own bound.
    """
    rows, shape = cut.collect(), "q long, row long, score long, upper long"
    if not rows:
        return cut.sparkSession.createDataFrame([], shape)
    queries = np.array(sorted({r["q"] for r in rows}), np.int64)
    at = {q: k for k, q in enumerate(queries.tolist())}
    bound, caps = np.zeros(len(queries)), np.zeros(len(queries))
    for r in rows:
        bound[at[r["q"]]] = r["bound"]
        caps[at[r["q"]]] += r["cap"]
    opened = sorted((r["term"], at[r["q"]], r["w"], r["least"], r["cap"]) for r in rows if r["most"] >= r["least"])
    terms, begin = np.unique(np.array([x[0] for x in opened], np.int64), return_index=True)
    begin = np.append(begin, len(opened))
    query, w, least, cap = (np.array([x[k] for x in opened], np.int64) for k in (1, 2, 3, 4))
    floor = np.minimum.reduceat(-(-least // w), begin[:-1])

    def add(row: np.ndarray, term: np.ndarray, impact: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        own, doc = np.unique(row, return_inverse=True)
        t = np.searchsorted(terms, term)
        n = begin[t + 1] - begin[t]
        each = np.repeat(np.arange(len(row)), n)
        ask = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[t], n)
        part = w[ask] * impact[each]
        ok = part >= least[ask]
        key = doc.reshape(-1)[each[ok]] * len(queries) + query[ask[ok]]
        size = len(own) * len(queries)
        # Whole numbers far below 2**53.
        score, seen = np.bincount(key, part[ok], size), np.bincount(key, cap[ask[ok]], size)
        score = score.reshape(len(own), -1)
        upper = score - seen.reshape(score.shape) + caps
        best[:] = np.partition(np.concatenate((best, score)), len(own), axis=0)[len(own) :]
        d, q = np.nonzero((score > 0) & (upper >= np.maximum(bound, best.min(0))))
        cols = [queries[q], own[d], score[d, q].astype(np.int64), upper[d, q].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "row", "score", "upper"])

    # A batch holds whole documents; a task holds so many cells of documents and queries at most.
    most = max(1, min(ADDED, 40_000_000 // max(1, len(queries))))

    def run(batches):
        held, n, best = [], 0, np.zeros((k, len(queries)))

        def settle(last: bool):
            nonlocal held, n
            row, term, impact = (np.concatenate([h[k] for h in held]) for k in range(3))
            end = len(row) if last else int(np.searchsorted(row, row[-1]))
            at = 0
            while at < end:
                stop = end if at + most >= end else max(int(np.searchsorted(row, row[at + most])), int(np.searchsorted(row, row[at], "right")))
                yield add(row[at:stop], term[at:stop], impact[at:stop], best)
                at = stop
            held, n = [(row[end:], term[end:], impact[end:])], len(row) - end

        for b in batches:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "term", "impact")))
            n += b.num_rows
            if n >= most:
                yield from settle(False)
        if n:
            yield from settle(True)

    spark = lists.sparkSession
    low = F.broadcast(spark.createDataFrame(list(zip(terms.tolist(), floor.tolist())), "term long, floor long"))
    read = lists.join(low, "term").where(F.col("impact") >= F.col("floor")).select("row", "term", "impact")
    read = read.repartition(F.col("row")).sortWithinPartitions("row")
    return common.stored(read.mapInArrow(run, shape), "partial")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col``, rank, ``id_col`` and score: the k documents of highest score above 0 for each query, equal scores by id."""
    spark = docs.sparkSession
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((items, item_col), (docs, id_col))}
    empty = spark.createDataFrame([], f"`{item_col}` {kinds[item_col]}, rank int, `{id_col}` {kinds[id_col]}, score long")

    # Queries: one row for each of their terms.
    asked = items.select(F.col(item_col).alias("item"), _body(item_text_col)).distinct()
    asked = common.stored(terms_of(common.stored(asked, "items"), f"item {kinds[item_col]}").select("item", F.col("row").alias("q"), "terms"), "asked")
    wanted = asked.select("q", F.explode("terms").alias("term"))
    vocabulary = common.stored(wanted.select("term").distinct(), "vocabulary")
    if common.at_most(vocabulary, 0):
        return empty
    held = np.array(sorted(r[0] for r in vocabulary.collect()), np.int64) if common.at_most(vocabulary, HELD_TERMS) else None

    # Documents: lengths, and the terms that queries ask for.
    found = terms_of(docs.select(F.col(id_col).alias("d"), _body(text_col)), f"d {kinds[id_col]}", held)
    found = common.stored(found.where("n > 0"), "found", "n")
    documents, length = found._rows, found._total
    if not documents:
        return empty
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if held is None:
        df = df.join(vocabulary, "term")
    w = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = common.stored(df.select("term", "df", w.alias("w")).where("w > 0"), "weights")
    lists = posting_lists(found, weights, documents, length)

    # 1. Heads of all lists; the k-th partial score of a query is its first bound.
    part = F.struct("term", "part").alias("list")
    heads = top(lists.withColumn("list", part), k, "list", F.desc("impact"), "row").drop("r", "list")
    heads = common.stored(top(heads, k, "term", F.desc("impact"), "row").drop("part"), "heads")
    lead = heads.where("r = 1").select("term", F.col("impact").alias("most"))
    asks = wanted.join(common.hinted(weights), "term").join(common.hinted(common.stored(lead, "lead")), "term")
    asks = common.stored(asks.select("q", "term", "w", (F.col("w") * F.col("most")).alias("most")), "asks")
    first = met(heads.drop("r"), asks).groupBy("q", "row").agg(_score())
    first = common.stored(top(first, k, "q", F.desc("score"), "row").select("q", "row"), "first")
    known = looked_up(lists, first, asks).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("bound"))
    bound = common.stored(known.where(F.col("n") == k).select("q", "bound"), "bound")

    # 2. Every list down to the threshold, in blocks of queries.
    cut = common.stored(thresholds(asks, bound), "cut")
    blocks = max(-(-cut._rows // common.BROADCAST_ROWS), -(-asked._rows * k // BEST))
    block = F.pmod(F.xxhash64("q"), F.lit(2 * blocks if blocks > 1 else 1))
    parts = [partial_scores(lists, cut.where(block == x), k) for x in range(2 * blocks if blocks > 1 else 1)]
    partial = reduce(DataFrame.unionByName, parts)
    raised = top(partial, k, "q", F.desc("score"), "row").where(F.col("r") == k).select("q", F.col("score").alias("raised"))
    left = partial.join(common.hinted(common.stored(raised, "raised")), "q", "left").where(F.col("upper") >= F.coalesce("raised", F.lit(0)))
    left = common.stored(left.select("q", "row"), "candidates")

    # 3. Exact scores of those that are left.
    exact = looked_up(lists, left, asks).where("score > 0")
    some = common.stored(exact.select("row").distinct(), "rows")
    ids = common.stored(found.select("row", "d").join(common.hinted(some), "row"), "ids")
    out = top(exact.join(common.hinted(ids), "row"), k, "q", F.desc("score"), "d", "row")
    out = out.join(common.hinted(asked.select("q", "item")), "q")
    return out.select(F.col("item").alias(item_col), F.col("r").cast("int").alias("rank"), F.col("d").alias(id_col), "score")
