"""Nucleotide scalar functions on string columns: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the 2-bit codes.
CODES = "ACTG"
#: One bit of each 2-bit field of a long.
FIELDS = 6148914691236517205


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), ""), lambda x: x != "")


def encode_bases(c: Column | str) -> Column:
    """Bases to digits 0..3; N, which two bits have no room for, becomes G's."""
    return F.translate(F.upper(_col(c)), CODES + "N", "01233")


def decode_bases(c: Column | str) -> Column:
    return F.translate(_col(c), "0123", CODES)


def revcomp(c: Column | str) -> Column:
    """Reverse complement, folded to upper case; N becomes C, as N is taken for G."""
    return F.reverse(F.translate(F.upper(_col(c)), "ACGTN", "TGCAC"))


def pack(c: Column | str) -> Column:
    """Up to 31 bases as a long, two bits each, the first base highest."""
    return F.aggregate(chars(encode_bases(c)), F.lit(0).cast("long"), lambda a, x: a * 4 + x.cast("long"))


def pack_words(c: Column | str) -> Column:
    """Bases of any number as longs of up to 31 each."""
    c = _col(c)
    n = F.ceil(F.length(c) / 31).cast("int")
    at = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    return F.transform(at, lambda i: pack(F.substring(c, i * 31 + 1, F.lit(31))))


def pack_bytes(c: Column | str) -> Column:
    """Four bases a byte, the last byte filled with zeros, as hex."""
    code = encode_bases(c)
    padded = F.rpad(code, F.ceil(F.length(code) / 4).cast("int") * 4, "0")
    quads = F.when(F.length(code) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.ceil(F.length(code) / 4).cast("int") - 1))
    byte = lambda i: F.aggregate(chars(F.substring(padded, i * 4 + 1, F.lit(4))), F.lit(0).cast("long"), lambda a, x: a * 4 + x.cast("long"))
    return F.array_join(F.transform(quads, lambda i: F.lpad(F.lower(F.hex(byte(i))), 2, "0")), "")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: ~x.eqNullSafe(y)), lambda z: z)).cast("long")


def packed_hamming(a: Column, b: Column) -> Column:
    """Different bases of two packed longs: fold each 2-bit field of the XOR to one bit and count."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(FIELDS))).cast("long")


def packed_words_hamming(a: Column, b: Column) -> Column:
    """Different bases of two equally long sequences, packed to words."""
    return F.aggregate(F.zip_with(a, b, packed_hamming), F.lit(0).cast("long"), lambda n, x: n + x)


def diff_keep(a: Column | str, b: Column | str) -> Column:
    """For each base of ``a`` 0 if ``b`` has it too, else its code."""
    return F.array_join(F.zip_with(chars(encode_bases(a)), chars(encode_bases(b)), lambda x, y: F.when(x == y, F.lit("0")).otherwise(x)), "")


def diff_xor(a: Column | str, b: Column | str) -> Column:
    return F.array_join(F.zip_with(chars(encode_bases(a)), chars(encode_bases(b)), lambda x, y: x.cast("int").bitwiseXOR(y.cast("int")).cast("string")), "")


def canonical(c: Column | str, middle: int = 16) -> Column:
    """The strand whose middle base is G or T."""
    c = _col(c)
    return F.when(F.substring(c, middle, 1).isin("G", "T"), c).otherwise(revcomp(c))


def flipped(c: Column | str, middle: int = 16) -> Column:
    return (~F.substring(_col(c), middle, 1).isin("G", "T")).cast("int")


def n_count(c: Column | str) -> Column:
    c = _col(c)
    return (F.length(c) - F.length(F.translate(c, "Nn", ""))).cast("long")
