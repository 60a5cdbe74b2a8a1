"""Configured filters: chains for hits, and named filters of variants.

Variant filters don't drop rows; each adds a column that is true where a variant fails,
and the runner sums them up as one text, as a variant file's FILTER column has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import hits as H
from strandline.operators import restriction as R
from strandline.operators import variants as V

HIT_FILTERS: dict[str, Callable[..., DataFrame]] = {"best_scores": H.best_scores, "score_threshold": H.score_threshold, "min_length": H.min_length}


def filter_hits(parts: DataFrame, config: list[dict]) -> DataFrame:
    """The configured filters in their order, each a dict of its ``kind`` and arguments; queries left without a part are gone."""
    for c in config:
        args = dict(c)
        kind = args.pop("kind")
        if kind not in HIT_FILTERS:
            raise ValueError(f"no such filter of hits: {kind}")
        parts = HIT_FILTERS[kind](parts, **args)
    return parts


def query_spans(parts: DataFrame) -> DataFrame:
    """The spans of queries that any part matches."""
    return parts.select("query", F.col("q_start").alias("start"), F.col("q_end").alias("end"))


def by_score(parts: DataFrame, score: str = "expect", ascending: bool = True) -> DataFrame:
    """Parts of each match as one array, best first."""
    key = F.col(score) if ascending else -F.col(score)
    rows = F.array_sort(F.collect_list(F.struct(key.alias("_k"), "q_start", "q_end", "s_start", "s_end", F.col(score).alias("score"))))
    return parts.groupBy("query", "subject").agg(F.transform(rows, lambda x: x.dropFields("_k")).alias("parts"))


# The short names of variant filters and their descriptions.
DESCRIPTIONS = {
    "uniq_contiguous": ("UCR", "Region is not unique or non contiguous"),
    "close_to_intron": ("I%2d", "An intron is located closer than %2d base pairs"),
    "high_variable_reg": ("HVR%d", "The region has more than %d snvs per 100 bases"),
    "close_to_snv": ("cs%s%2d%s", "The snv is closer than %d nucleotides to another %s%s"),
    "close_to_limit": ("cl%2d", "The snv is closer than %d nucleotides the reference edge"),
    "maf": ("maf%d", "The most frequent allele in %s: %s. frequency greater than %.2f"),
    "by_kind": ("vk%s", "It is not an %s"),
    "cap_enzymes": ("ce%s", "SNV is not a CAP detectable by the enzymes: %s"),
    "is_variable": ("v%s%i", "It is not variable, or no data, in the %s : %s. All together: %s"),
    "is_not_variable": ("nv%s%i", "It is variable, or no data, in the %s : %s. All together: %s"),
    "ref_not_in_list": ("rnl", "Filters by given list of seq names"),
    "min_groups": ("m%s%i", "SNV read in less than %i %s"),
    "in_segment_bed": ("is%i", "The snv is outside the given segments reduced in %i bases from each edge"),
}
_GROUPS = {"libraries": "lb", "read_groups": "rg", "samples": "sm"}


@dataclass(frozen=True)
class Filter:
    """A variant filter: ``fn(snvs, out=column, **args)`` adds the column; ``params`` are what its name tells."""

    kind: str
    fn: Callable[..., DataFrame]
    args: dict = field(default_factory=dict)
    params: tuple = ()


def filter_names(filters: list[Filter]) -> list[tuple[str, str]]:
    """(short name, description) of each filter; maf and variability filters are numbered in their order."""
    counts: dict[str, int] = {}
    out = []
    for f in filters:
        short, text = DESCRIPTIONS[f.kind]
        p = f.params
        if f.kind in ("maf", "is_variable", "is_not_variable"):
            counts[f.kind] = counts.get(f.kind, 0) + 1
        if f.kind == "by_kind":
            got = short % p[0].lower()[0], text % p[0].lower()
        elif f.kind == "cap_enzymes":
            got = short % ("t" if p[0] else "f"), text % ("all" if p[0] else "cheap ones")
        elif f.kind in ("is_variable", "is_not_variable"):
            got = short % (_GROUPS[p[0]], counts[f.kind]), text % (p[0], ",".join(map(str, p[1])), p[2])
            # A filter of variability tells a seventh parameter, one of invariance has none between: maf and reads stand last.
            maf, least = (p[5], p[6]) if len(p) >= 7 else (p[4], p[5]) if len(p) == 6 else (None, None)
            if maf and least:
                got = got[0], f"{got[1]}. maf:{maf:f}. min_num_reads:{least}"
        elif f.kind == "in_segment_bed":
            got = short % (p[0] if p and p[0] else 0), text % (p[0] if p and p[0] else 0)
        elif f.kind == "maf":
            kind, groups = (p[2], ",".join(map(str, p[1]))) if len(p) > 1 else ("All", "All")
            got = short % counts[f.kind], text % (kind, groups, p[0])
        elif f.kind == "high_variable_reg":
            got = short % int(p[0] * 100), text % int(p[0] * 100)
        elif f.kind == "min_groups":
            got = short % (p[1][0], p[0]), text % (p[0], p[1])
        elif f.kind == "close_to_snv":
            kind, maf = p[1] if len(p) > 1 else None, p[2] if len(p) > 2 else None
            got = short % (kind[0] if kind else "", p[0], f"_{maf:2f}" if maf else ""), text % (p[0], kind or "all", f", with maf:{maf:2f}" if maf else "")
        else:
            got = (short % p if "%" in short else short), (text % p if "%" in text else text)
        out.append(got)
    return out


def filter_snvs(snvs: DataFrame, filters: list[Filter], out: str = "filters") -> DataFrame:
    """``snvs`` with a boolean column for each filter's short name, and ``out``: the upper-case names of those that fail, PASS, or . without filters."""
    if not filters:
        return snvs.withColumn(out, F.lit("."))
    named = []
    for (short, _), f in zip(filter_names(filters), filters):
        name = short.replace(" ", "0").replace(".", "_")
        snvs = f.fn(snvs, **f.args, out=name)
        named.append((short, name))
    failed = F.array_join(F.array(*[F.when(F.col(name), F.lit(short.upper())) for short, name in named]), ";")
    return snvs.withColumn(out, F.coalesce(F.nullif(failed, F.lit("")), F.lit("PASS")))


def vcf_filter_lines(filters: list[Filter]) -> list[str]:
    """Header lines that describe the filters."""
    return [f'##FILTER=<ID={short.upper()},Description="{text}">' for short, text in filter_names(filters)]


STANDARD = {"close_to_snv": V.close_to_snv, "high_variable_reg": V.high_variable_region, "close_to_limit": V.close_to_limit, "close_to_intron": V.close_to_intron, "maf": V.max_maf, "by_kind": V.by_kind, "min_groups": V.min_groups, "in_segment_bed": V.in_segment, "ref_not_in_list": V.ref_not_in_list, "is_variable": V.variable_in, "is_not_variable": V.invariant_in, "uniq_contiguous": V.not_unique, "cap_enzymes": R.not_told}


def standard(kind: str, params: tuple = (), **args) -> Filter:
    """A filter of the library by its name."""
    return Filter(kind, STANDARD[kind], args, params)
