"""Column functions on sequences held as strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each base and its complement (fixed values, IUPAC codes).
BASES = "ACGTURYMKBVDHacgturymkbvdh"
COMPLEMENTS = "TGCAAYRKMVBHDtgcaayrkmvbhd"
#: Amino acids of the standard code, codons in TCAG order (fixed values).
CODON_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def forward_strand(kmer: Column) -> Column:
    """Whether a k-mer is its own canonical form."""
    return kmer <= reverse_complement(kmer)


def hash60(text: Column) -> Column:
    """A positive 60-bit hash that any engine with MD5 gives alike."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def has_lower(text: Column) -> Column:
    return text.rlike("[a-z]")


def upper_ascii(text: Column) -> Column:
    return F.translate(text, _LETTERS, _LETTERS.upper())


def simplify_name(name: Column) -> Column:
    """Up to the first space, point, comma or hyphen."""
    return F.regexp_extract(name, r"^[^ .,\-]*", 0)


def file_stem(path: Column) -> Column:
    """A file's name up to its first point."""
    return F.split_part(F.regexp_extract(path, r"[^/]*$", 0), F.lit("."), F.lit(1))


def odd_window(w: int) -> int:
    return w + (w + 1) % 2


def translate_frame(seq: Column, frame: int) -> Column:
    """Translation from base ``frame`` (0 to 2), whole codons only; X where a base is unknown.

    The sequence is cut into codons once; a codon's place in the list of all codons is that of its residue in the table.
    """
    every = ",".join(a + b + c for a in CODON_ORDER for b in CODON_ORDER for c in CODON_ORDER)
    codons = F.regexp_extract_all(F.translate(F.substring(seq, frame + 1, 1 << 30), "U,", "TN"), F.lit("(...)"), 1)
    residue = lambda d: F.substring(F.lit("X" + AMINO_ACIDS), F.shiftright(F.instr(F.lit(every), d) + 3, 2) + 1, F.lit(1))
    return F.array_join(F.transform(codons, residue), "")


def kmers(seq: Column, k: int) -> Column:
    """All k-windows of a sequence, in order; none if it is shorter.  One pass of a pattern that looks ahead, so the cost does not grow with the place."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def mash_distance(jaccard: Column, k: int) -> Column:
    return F.when(jaccard == 0, F.lit(1.0)).otherwise(-F.log(2 * jaccard / (1 + jaccard)) / k)


def gap_units(dx: Column, dy: Column, unit: int) -> Column:
    """Gap units of a step of a chain, in single precision."""
    return (F.greatest(dx, dy).cast("float") / F.lit(float(unit)).cast("float") + F.lit(0.5).cast("float")).cast("int")


def gap_penalty(units: Column, opening: float, extension: float) -> Column:
    return F.when(units > 0, F.lit(opening) + units * F.lit(extension)).otherwise(F.lit(0.0))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def token_score(a: Column, b: Column, match: float = 1.0, mismatch: float = -0.2) -> Column:
    return F.when(a == b, F.lit(match)).otherwise(F.lit(mismatch))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def polar(radius: Column, angle: Column, centre_x: float, centre_y: float) -> tuple[Column, Column]:
    return centre_x + radius * F.cos(angle), centre_y + radius * F.sin(angle)


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for ``n`` values at a false-positive rate."""
    bits = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))
