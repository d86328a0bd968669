"""Column functions over sequence texts. All stay in the JVM (no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED_AMINO_ACIDS = AMINO_ACIDS + "BXZUO"
# The standard genetic code, codons in TCAG order.
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sequence_length(c: Column | str) -> Column:
    """Characters, as BIGINT; null stays null."""
    return F.length(_col(c)).cast("long")


def sequence_hash(c: Column | str) -> Column:
    """Frame hash: 16 hex digits of the SHA-256 of the upper-cased text."""
    return F.substring(F.sha2(F.upper(_col(c)), 256), 1, 16)


def store_hash(c: Column | str) -> Column:
    """Store hash: 32 hex digits of the SHA-256 of the text as it is."""
    return F.substring(F.sha2(_col(c), 256), 1, 32)


def row_hash(cols: Sequence[str]) -> Column:
    """Store hash of several columns: values in order of column name, joined by NUL; null if any is null."""
    parts = [F.col(c).cast("string") for c in sorted(cols)]
    any_null = F.lit(False)
    for p in parts:
        any_null = any_null | p.isNull()
    return F.when(~any_null, F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32))


def detect_type(c: Column | str) -> Column:
    """dna, rna, protein or unknown. Chain marks ':' don't count; an empty text is dna, null is null."""
    s = F.replace(F.upper(_col(c)), F.lit(":"), F.lit(""))
    return F.when(s.isNull(), None).when(s.rlike(r"^[ATCGN]*\z"), "dna").when(s.rlike(r"^[AUCGN]*\z"), "rna").when(s.rlike(rf"^[{AMINO_ACIDS}*]*\z"), "protein").otherwise("unknown")


def reverse_complement(c: Column | str) -> Column:
    """Upper-cased, A/T and C/G swapped, other characters kept, reversed."""
    return F.reverse(F.translate(F.upper(_col(c)), "ATCG", "TAGC"))


def translate_codons(c: Column | str) -> Column:
    """Protein of a coding strand: U read as T, stop as '*', a rest of one or two bases ignored, unknown codons 'X'."""
    s = F.upper(_col(c))
    # Codons as numbers of three digits, one per base in table order; what isn't a base makes no number.
    digits = F.regexp_extract_all(F.translate(s, "U" + CODON_BASES, "00123"), F.lit("(?s)(...)"), F.lit(1))
    at = {int("".join(d)): aa for d, aa in zip(product("0123", repeat=3), CODON_RESIDUES)}
    table = F.array(*[F.lit(at.get(i, "X")) for i in range(max(at) + 1)])
    number = lambda x: F.when(x.rlike("^[0-3]{3}$"), x.try_cast("int"))
    residue = lambda x: F.coalesce(F.get(table, number(x)), F.lit("X"))
    return F.when(s.isNull(), None).otherwise(F.array_join(F.transform(digits, residue), ""))


def characters(c: Column | str) -> Column:
    """The characters as an array; reading all of them is linear, which ``substring`` at each place is not."""
    return F.filter(F.split(_col(c), ""), lambda x: x != "")


def _mismatches(a: Column, b: Column) -> Column:
    """Places of the common length that differ."""
    differ = F.zip_with(characters(a), characters(b), lambda x, y: x != y)
    return F.when(a.isNotNull() & b.isNotNull(), F.size(F.filter(differ, lambda x: F.coalesce(x, F.lit(False)))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ in the common length, plus the difference in length (BIGINT)."""
    a, b = _col(a), _col(b)
    la, lb = F.length(a), F.length(b)
    return (_mismatches(a, b) + F.abs(la - lb)).cast("long")


def hamming_normalized(a: Column | str, b: Column | str) -> Column:
    """``hamming`` over the longer length; 0 for two empty texts."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(hamming(a, b) / longest)


def identity(a: Column | str, b: Column | str) -> Column:
    """Equal places over the shorter length; 0 if one is empty."""
    a, b = _col(a), _col(b)
    short = F.least(F.length(a), F.length(b))
    return F.when(short == 0, F.lit(0.0)).otherwise((short - _mismatches(a, b)) / short)


def matches_alphabet(c: Column | str, alphabet: str = AMINO_ACIDS, empty: bool = False) -> Column:
    """Whether every character is of the alphabet (no text at all counts only if ``empty``)."""
    chars = "".join("\\" + x if not x.isalnum() else x for x in alphabet)
    return _col(c).rlike(rf"^[{chars}]{'*' if empty else '+'}\z")


def validate_sequence(c: Column | str, kind: str = "protein") -> Column:
    """Whether the upper-cased text is a protein or DNA; empty is."""
    alphabet = {"protein": AMINO_ACIDS, "dna": "ACGT"}.get(kind)
    if alphabet is None:
        raise ValueError(f"unknown kind {kind!r}")
    return matches_alphabet(F.upper(_col(c)), alphabet, empty=True)


def occurrences(c: Column | str, token: str) -> Column:
    """How often ``token`` stands in the text, not overlapping (BIGINT)."""
    if not token:
        raise ValueError("empty token")
    s = _col(c)
    return ((F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / len(token)).cast("long")


def single_occurrence(c: Column | str, token: str) -> Column:
    return occurrences(c, token) == 1


def any_occurrence(c: Column | str, tokens: Sequence[str]) -> Column:
    """Whether at least one of the tokens occurs."""
    out = F.lit(False)
    for t in tokens:
        out = out | (occurrences(c, t) >= 1)
    return out


def extended_with(c: Column | str, extra: Sequence[str], alphabet: str = EXTENDED_AMINO_ACIDS) -> Column:
    """Whether the text is of the alphabet once the extra tokens are taken out."""
    s = _col(c)
    for t in extra:
        s = F.replace(s, F.lit(t), F.lit(""))
    return matches_alphabet(s, alphabet, empty=True)


def has_atoms(c: Column | str) -> Column:
    """Whether a structure text has atom records."""
    return F.contains(_col(c), F.lit("ATOM"))


def length_bin(c: Column | str, bounds: Sequence[int]) -> Column:
    """Label of the length's bin: '<b1', 'b1-b2' (upper bound exclusive), ..., '>bn'."""
    bounds = sorted(bounds)
    if not bounds:
        raise ValueError("no bounds")
    n = F.length(_col(c))
    out = F.when(n < bounds[0], f"<{bounds[0]}")
    for lo, hi in zip(bounds, bounds[1:]):
        out = out.when(n < hi, f"{lo}-{hi}")
    return out.when(n >= bounds[-1], f">{bounds[-1]}")


def mutate_at(c: Column | str, position: Column | int, residue: Column | str) -> Column:
    """The text with the character at the 0-based position replaced."""
    s = _col(c)
    p = F.lit(position) if isinstance(position, int) else position
    r = F.lit(residue) if isinstance(residue, str) else residue
    return F.overlay(s, r, p + 1, F.lit(1))


def apply_mask(c: Column | str, positions: Column, mask: str = "<mask>") -> Column:
    """The text with the characters at the 0-based positions replaced by the mask token."""
    return F.array_join(F.transform(characters(c), lambda x, i: F.when(F.array_contains(positions.cast("array<int>"), i), mask).otherwise(x)), "")


def mutation_count(a: Column | str, b: Column | str) -> Column:
    """Places of the common length that differ (BIGINT)."""
    a, b = _col(a), _col(b)
    return _mismatches(a, b).cast("long")


def usable_text(c: Column | str) -> Column:
    """Whether a text may go to a scorer: not null, blank, 'nan' or 'none'."""
    return F.coalesce(~F.lower(F.trim(_col(c))).isin("", "nan", "none"), F.lit(False))


def annotation_json(name: Column | str, c: Column | str) -> Column:
    """A JSON sequence record {name, type, seq, annotations}."""
    return F.to_json(F.struct(_col(name).alias("name"), detect_type(c).alias("type"), _col(c).alias("seq"), F.array().cast("array<string>").alias("annotations")))
