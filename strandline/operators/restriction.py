"""Restriction enzymes that tell the alleles of a variant apart.

All recognition sites, with their ambiguous letters and on both strands, are one automaton that reads a
text once: a bit for each letter of each site, moved on by every letter of the text.  It runs over
pieces of the references once, for where each enzyme cuts at all, and over each allele with
the few bases around it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common enzymes and their recognition sites.
COMMON = {
    "EcoRI": "GAATTC", "SmaI": "CCCGGG", "BamHI": "GGATCC", "AluI": "AGCT", "BglII": "AGATCT", "SalI": "GTCGAC", "BglI": "GCCNNNNNGGC", "ClaI": "ATCGAT", "TaqI": "TCGA", "PstI": "CTGCAG", "PvuII": "CAGCTG", "HindIII": "AAGCTT",
    "EcoRV": "GATATC", "HaeIII": "GGCC", "KpnI": "GGTACC", "ScaI": "AGTACT", "HinfI": "GANTC", "DraI": "TTTAAA", "ApaI": "GGGCCC", "BstEII": "GGTNACC", "ZraI": "GACGTC", "BanI": "GGYRCC", "Asp718I": "GGTACC",
}
# What the letters of a site stand for, and their complements.
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
#: Bases of a reference in a piece.
PIECE = 10_000


class Automaton:
    """Finds every occurrence of every site; letters other than A, C, G and T (in either case) match nothing."""

    def __init__(self, enzymes: dict[str, str]):
        self.begin, self.end, self.letters = 0, {}, {c: 0 for c in "ACGT"}
        self.longest, at = max(map(len, enzymes.values()), default=0), 0
        self.ends = 0
        for name, site in sorted(enzymes.items()):
            for form in sorted({site.upper(), site.upper().translate(_COMPLEMENT)[::-1]}):
                self.begin |= 1 << at
                for k, c in enumerate(form):
                    for base in AMBIGUOUS[c]:
                        self.letters[base] |= 1 << (at + k)
                at += len(form)
                self.end[1 << (at - 1)] = (name, len(form))
                self.ends |= 1 << (at - 1)

    def find(self, text: str) -> dict[str, tuple[int, int, int]]:
        """(end of the first site, beginning of the last one, number) of each enzyme that cuts ``text``."""
        state, out = 0, {}
        letters, begin, ends = self.letters, self.begin, self.ends
        for k, c in enumerate(text.upper()):
            state = (state << 1 | begin) & letters.get(c, 0)
            hit = state & ends
            while hit:
                bit = hit & -hit
                name, n = self.end[bit]
                first, last, count = out.get(name, (k, k - n + 1, 0))
                out[name] = (min(first, k), max(last, k - n + 1), count + 1)
                hit ^= bit
        return out


def sites(text: Column, enzymes: dict[str, str] | None = None) -> Column:
    """Array of (enzyme, first, last, n) of each text: the end of its first site, the beginning of its last one, and how many there are."""
    table = COMMON if enzymes is None else enzymes

    @F.pandas_udf("array<struct<enzyme:string,first:int,last:int,n:int>>")
    def find(texts: pd.Series) -> pd.Series:
        automaton = Automaton(table)
        return pd.Series([[{"enzyme": e, "first": a, "last": b, "n": n} for e, (a, b, n) in sorted(automaton.find(t or "").items())] for t in texts])

    return find(text)


def _pieces(reference: DataFrame, over: int) -> DataFrame:
    """Pieces of references, each with ``over`` bases of its neighbours: name, piece, from, text."""
    n = F.ceil(F.length("seq") / PIECE).cast("int")
    rows = reference.where(F.length("seq") > 0).select("name", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.greatest(F.col("piece") * PIECE - over, F.lit(0))
    return rows.select("name", "piece", start.alias("from"), F.substring(F.col("seq"), start + 1, (F.col("piece") + 1) * PIECE + over - start).alias("text"))


def cap_enzymes(snvs: DataFrame, alleles: DataFrame, reference: DataFrame, enzymes: dict[str, str] | None = None, snv: str = "snv_id", out: str = "enzymes") -> DataFrame:
    """``snvs`` (``snv``, name, start, end) with the sorted enzymes that cut the whole sequence with one of its alleles, but not with another.

    ``alleles`` has ``snv`` and allele, which takes the place of start to end, both included; its gaps go.  Variants of one allele have no such enzymes.
    """
    over = max(map(len, (COMMON if enzymes is None else enzymes).values()), default=1) - 1
    pieces = _pieces(reference, over)
    # Where an enzyme cuts a whole reference first and last.
    cut = pieces.select("name", "from", F.explode(sites(F.col("text"), enzymes)).alias("c"))
    cut = cut.groupBy("name", F.col("c.enzyme").alias("enzyme")).agg(F.min(F.col("from") + F.col("c.first")).alias("first"), F.max(F.col("from") + F.col("c.last")).alias("last"))
    cut = cut.groupBy("name").agg(F.collect_list(F.struct("enzyme", "first", "last")).alias("_cuts"))
    left = pieces.select(F.col("name"), F.col("piece").alias("_p"), F.col("from").alias("_f"), F.col("text").alias("_t"))
    right = pieces.select(F.col("name"), F.col("piece").alias("_q"), F.col("from").alias("_g"), F.col("text").alias("_u"))
    near = snvs.select(snv, "name", "start", "end").withColumn("_p", F.floor(F.col("start") / PIECE).cast("int")).withColumn("_q", F.floor(F.col("end") / PIECE).cast("int")).join(left, ["name", "_p"]).join(right, ["name", "_q"])
    begin = F.greatest(F.col("start") - over, F.col("_f"))
    before = F.substring(F.col("_t"), (begin - F.col("_f") + 1).cast("int"), (F.col("start") - begin).cast("int"))
    after = F.substring(F.col("_u"), (F.col("end") - F.col("_g") + 2).cast("int"), F.lit(over))
    near = near.select(snv, "name", "start", "end", before.alias("_before"), after.alias("_after"))
    each = near.join(alleles.select(snv, "allele").distinct(), snv)
    each = each.withColumn("_s", F.transform(sites(F.concat("_before", F.regexp_replace("allele", "-", ""), "_after"), enzymes), lambda x: x["enzyme"]))
    told = each.groupBy(snv, "name", "start", "end").agg(F.flatten(F.collect_list("_s")).alias("_all"), F.count("*").alias("_n"))
    told = told.join(cut, "name", "left").withColumn("_flank", F.transform(F.filter("_cuts", lambda c: (c["first"] < F.col("start")) | (c["last"] > F.col("end"))), lambda c: c["enzyme"]))
    some = F.filter(F.array_distinct("_all"), lambda e: (F.size(F.filter("_all", lambda x: x == e)) < F.col("_n")) & ~F.coalesce(F.array_contains("_flank", e), F.lit(False)))
    got = told.select(snv, F.array_sort(some).alias(out))
    return snvs.join(got, snv, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def not_told(snvs: DataFrame, alleles: DataFrame, reference: DataFrame, enzymes: dict[str, str] | None = None, snv: str = "snv_id", out: str = "cap_enzymes") -> DataFrame:
    """The filter: true where no enzyme tells a variant's alleles apart."""
    return cap_enzymes(snvs, alleles, reference, enzymes, snv, "_e").withColumn(out, F.size("_e") == 0).drop("_e")
