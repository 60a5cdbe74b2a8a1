"""Functions on nucleotide strings, their qualities and their colour-space forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC complements; A and T (U), C and G, M and K, R and Y, V and B, H and D pair; the rest stay.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTMRWSYKVHDBXNacgtmrwsykvhdbxn", "TGCAKYWSRMBDHVXNtgcakywsrmbdhvxn"
# IUPAC codes of sets of bases, as sorted strings.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}
# The colour of two neighbouring bases.
COLOURS = {"AA": "0", "CC": "0", "GG": "0", "TT": "0", "AC": "1", "CA": "1", "GT": "1", "TG": "1", "AG": "2", "GA": "2", "CT": "2", "TC": "2", "AT": "3", "TA": "3", "CG": "3", "GC": "3"}


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper(seq: Column) -> Column:
    """Upper case of ASCII letters; lengths stay as they are."""
    return F.translate(seq, _LOWER, _UPPER)


def letters(seq: Column) -> Column:
    """The characters of a string, in order; an empty array for an empty one."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def double_encode(seq: Column) -> Column:
    """Colour codes written as bases."""
    return F.translate(seq, ".0123", "NACGT")


def to_colour_space(seq: Column) -> Column:
    """The first base, then the colour of each pair of neighbours; unknown pairs are dots."""
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    pairs = F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.coalesce(F.try_element_at(table, F.upper(F.substring(seq, i, F.lit(2)))), F.lit(".")))
    return F.when(F.length(seq) < 2, seq).otherwise(F.concat(F.substring(seq, 1, 1), F.array_join(pairs, "")))


def iupac_code(alleles: Column) -> Column:
    """The code of an array of bases; null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.try_element_at(table, F.array_join(F.sort_array(F.array_distinct(F.transform(alleles, lambda x: F.upper(x)))), ""))


def phred(text: Column, offset: int = 33) -> Column:
    """Qualities of a quality string, clamped to 0..93."""
    return F.transform(letters(text), lambda c: F.least(F.greatest(F.ascii(c) - offset, F.lit(0)), F.lit(93)))


def phred_text(quality: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(quality, lambda q: F.char(q + offset)), "")


def solexa_to_phred(quality: Column) -> Column:
    """Solexa scores as phred scores, cut to integers."""
    return F.transform(quality, lambda q: (10 * F.log10(F.pow(F.lit(10.0), q / 10.0) + 1)).cast("int"))


def rms(values: Column) -> Column:
    """Root of the mean square of an array of numbers."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(values))


def base_class(base: Column) -> Column:
    b = F.upper(base)
    return F.when(b.isin("A", "G"), "purine").when(b.isin("C", "T"), "pyrimidine").otherwise("unknown")


def is_peptide(pep: Column) -> Column:
    return pep.rlike("^M[^UOBZJX]*$")


def is_dna(seq: Column) -> Column:
    return seq.rlike("(?i)^[ATCG]*$")


def unmasked_length(seq: Column) -> Column:
    """Upper-case A, C, G and T."""
    return F.length(F.regexp_replace(seq, "[^ATCG]", ""))


def read_name(name: Column, id_: Column) -> Column:
    """The name, else the id, else a new one."""
    blank = F.lit("<unknown name>")
    return F.coalesce(F.nullif(name, blank), F.nullif(id_, F.lit("<unknown id>")), F.uuid())


_CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(dna: Column) -> Column:
    """Amino acids of whole codons (standard code, stops as *, unknown codons as X)."""
    order = "TCAG"
    pairs = [(a + b + c, _CODONS[16 * i + 4 * j + k]) for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    dna = F.upper(F.translate(dna, "uU", "tT"))
    # One pass cuts the codons; a substring for each would begin at the text's beginning.
    codons = F.transform(F.regexp_extract_all(dna, F.lit("(?s).{3}"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    return F.when(F.length(dna) < 3, F.lit("")).otherwise(F.array_join(codons, ""))
