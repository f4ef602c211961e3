"""Column functions on symbols: cleaning, encoding, complements and k-mer numbers.

Codes are one byte a symbol in the order T, C, A, G (0 to 3); codes of 4 and more are not canonical. k-mer numbers and
the order of k-mers follow the codes, not the letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "TCAG"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands for a code that is not canonical; it separates k-mers.
UNKNOWN = "N"


def clean(text: Column, digits: bool = False) -> Column:
    """ASCII letters to upper case; gaps and white space (and digits) deleted."""
    return F.translate(text, LOWER + "\n\r\t- " + ("0123456789" if digits else ""), UPPER)


def degap(text: Column) -> Column:
    return F.translate(text, "-", "")


def to_rna(text: Column) -> Column:
    return F.translate(text, "T", "U")


def to_dna(text: Column) -> Column:
    return F.translate(text, "U", "T")


def codes_to_text(data: Column, alphabet: str = DNA, unknown: str = UNKNOWN, max_length: int | None = None) -> Column:
    """Encoded bytes as letters, at most max_length of them; every code beyond the alphabet as `unknown`."""
    raw = F.decode(data if max_length is None else F.substring(data, 1, max_length), "ISO-8859-1")
    known = "".join(map(chr, range(len(alphabet))))
    # bytes below 32 that are no letters of the alphabet, then all others
    low = "".join(map(chr, range(len(alphabet), 32)))
    return F.regexp_replace(F.translate(raw, known + low, alphabet + unknown * len(low)), f"[^{alphabet}{unknown}]", unknown)


def text_to_codes(text: Column, alphabet: str = DNA, gap: int = 4, other: int = 5, max_length: int | None = None) -> Column:
    """Letters, at most max_length of them, as bytes: the alphabet from 0, the gap '-' and all else as codes that are not canonical."""
    if max_length is not None:
        text = F.substring(text, 1, max_length)
    if len(alphabet) > 10 or max(gap, other) > 9:
        raise ValueError("codes of text are one digit")
    # by hexadecimal pairs: a translation to the zero byte would delete the symbol
    digits = F.translate(F.regexp_replace(text, f"[^{alphabet}-]", "?"), alphabet + "-?", "0123456789"[: len(alphabet)] + f"{gap}{other}")
    return F.unhex(F.regexp_replace(digits, "(.)", "0$1"))


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(text, "TCAG", "AGTC"))


def kmer_digits(kmer: Column, alphabet: str = DNA) -> Column:
    return F.translate(kmer, alphabet, "0123456789"[: len(alphabet)])


def kmer_to_index(kmer: Column, alphabet: str = DNA) -> Column:
    """The k-mer as a number in base len(alphabet); with a symbol that is not canonical len(alphabet) ** k."""
    n = len(alphabet)
    number = F.conv(kmer_digits(kmer, alphabet), n, 10).cast("bigint")
    return F.when(kmer.rlike(f"^[{alphabet}]+$"), number).otherwise(F.pow(F.lit(n), F.length(kmer)).cast("bigint"))


def index_to_kmer(index: Column, k: int, alphabet: str = DNA) -> Column:
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, len(alphabet)), k, "0"), "0123456789"[: len(alphabet)], alphabet)


def canonical_kmer(kmer: Column) -> Column:
    """The lesser, in code order, of a k-mer and its reverse complement."""
    back = reverse_complement(kmer)
    return F.when(kmer_digits(back) < kmer_digits(kmer), back).otherwise(kmer)


def windows(text: Column, k: int, alphabet: str = DNA) -> Column:
    """All overlapping windows of k canonical symbols, in reading order; one pass over the text."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.regexp_extract_all(text, F.lit(f"(?=([{alphabet}]{{{k}}}))"), 1)
