"""One consistent form for texts that look the same (problem 9).

Method: normalisation quick check. A text is left as it is apart from its unstable segments: runs of characters
that are not stable under the form, with the one stable character before them as boundary context. Each segment
is decomposed, freed of invisible characters, mapped to the common look and composed again; the results are
spliced into the unchanged text.

The form keeps every visible difference: case, accents, digits, words, punctuation, line breaks and the number
of spaces. It unifies composed and decomposed accents, full-width, half-width and normal characters, all spaces
of category Zs, look-alike letters, and drops invisible characters (the property Default_Ignorable_Code_Point). A
zero-width joiner between two pictographs, a variation selector or tag after one, and a joiner or non-joiner between
letters of Arabic or Indic scripts change what is seen and stay.

Look-alikes are the letters whose outlines are those of a Latin letter in a widespread public font family with wide
coverage, and some that public lists of confusable characters name although their outlines differ a little: Greek small
letters, Cherokee, dotless i and script g. Left out: letters that only resemble a digit or a pair of letters, and
styled letters (bold, script, enclosed), which look different.

Defined cases: null gives null; empty gives empty; a text of any length is processed whole; repeated rows give
equal forms; further columns of the table are not touched by the column function.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from kmerloom.session import cut

# Letters drawn like a Latin letter, with that letter.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "α": "a", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ϝ": "F", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "հ": "h", "ո": "n", "ս": "u", "օ": "o", "Ս": "U", "Օ": "O",
    "ı": "i", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "ᐯ": "V", "ᑌ": "U", "ᒪ": "L", "ᕼ": "H", "ᗞ": "D", "ⴸ": "V", "ⴹ": "E", "ⵏ": "I", "ⵝ": "X",
    "\u2010": "-", "\u2011": "-",
}
# Ranges of code points that leave no mark.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE = frozenset(chr(c) for a, b in IGNORABLE for c in range(a, b + 1))
JOINING = r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}]"
TAGS = "[\U000e0020-\U000e007f]"
KEPT_JOINER = regex.compile(
    rf"(?<=\p{{Extended_Pictographic}}\ufe0f?)\u200d(?=\p{{Extended_Pictographic}})|(?<=\p{{Extended_Pictographic}})[\ufe0e\ufe0f]"
    rf"|(?<=\p{{Extended_Pictographic}}){TAGS}+|(?<={JOINING}\p{{M}}*)[\u200c\u200d](?={JOINING})"
)
MAYBE_KEPT = re.compile(f"[\u200c\u200d\ufe0e\ufe0f]|{TAGS}")


def _folded(ch: str) -> str:
    """The common look of one decomposed character."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if unicodedata.category(ch) == "Zs":
        return " "
    tag, _, parts = unicodedata.decomposition(ch).partition(" ")
    return "".join(chr(int(x, 16)) for x in parts.split()) if tag in ("<wide>", "<narrow>", "<noBreak>") else ch


def _unstable(ch: str) -> bool:
    return (
        ch in INVISIBLE
        or unicodedata.category(ch)[0] == "M"
        or unicodedata.normalize("NFC", ch) != ch
        or "ᅡ" <= ch <= "ᅵ"
        or "ᆨ" <= ch <= "ᇂ"
        or any(_folded(x) != x for x in unicodedata.normalize("NFD", ch))
    )


#: The database is read for these ranges of code points; what lies between is stable.
POINTS = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x12000), (0x16000, 0x17000), (0x1D000, 0x1FC00), (0x2F800, 0x2FA20), (0xE0100, 0xE01F0))
DROPPED = 0xFFFFFFFF
#: Segments that lie so close together are done as one.
NEAR = 6


@cache
def _tables() -> tuple[np.ndarray, dict[int, str], np.ndarray]:
    """By code point, whether it is unstable; the folding of decomposed characters as a mapping and by code point."""
    unstable, folded, fold = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32), {}
    for a, b in POINTS:
        for c in range(a, b):
            ch = chr(c)
            unstable[c] = _unstable(ch)
            if (f := _folded(ch)) != ch:
                fold[c] = f
                folded[c] = ord(f)
    for ch in INVISIBLE:
        fold[ord(ch)], folded[ord(ch)], unstable[ord(ch)] = "", DROPPED, True
    return unstable, fold, folded


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fold(text: str) -> str:
    """Decomposed text in the common look, without invisible characters."""
    if len(text) < 48:
        return text.translate(_tables()[1])
    points = _tables()[2][_points(text)]
    return points[points != DROPPED].tobytes().decode("utf-32-le", "surrogatepass")


def _segment(text: str) -> str:
    parts, at = [], 0
    if MAYBE_KEPT.search(text):
        for m in KEPT_JOINER.finditer(text):
            parts += [_fold(unicodedata.normalize("NFD", text[at : m.start()])), m.group()]
            at = m.end()
    parts.append(_fold(unicodedata.normalize("NFD", text[at:])))
    return unicodedata.normalize("NFC", "".join(parts))


_seen: dict[str, str] = {}


def _canonical(text: str) -> str:
    """A segment's form; short segments recur and are kept."""
    form = _seen.get(text)
    if form is None:
        form = _segment(text)
        if len(text) <= 8:
            if len(_seen) > 100_000:
                _seen.clear()
            _seen[text] = form
    return form


def _segments(text: str, near: int) -> list[tuple[int, int]]:
    """Start and end of each run of unstable characters, with the one stable character before it."""
    at = np.flatnonzero(_tables()[0][_points(text)])
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > near + 1)
    starts, ends = np.append(at[:1], at[gaps + 1]), np.append(at[gaps], at[-1:]) + 1
    return list(zip(np.maximum(starts - 1, 0).tolist(), ends.tolist()))


def _has_kept_joiner(text: str) -> bool:
    return MAYBE_KEPT.search(text) is not None and KEPT_JOINER.search(text) is not None


def visual_form(text: str | None) -> str | None:
    """The consistent form of a text."""
    if text is None or text.isascii():
        return text
    # a kept joiner needs the pictograph or letter after it, which is stable: such texts are segments as a whole
    if _has_kept_joiner(text):
        return _segment(text)
    parts, at = [], 0
    for a, b in _segments(text, NEAR):
        parts += [text[at:a], _canonical(text[a:b])]
        at = b
    return "".join([*parts, text[at:]]) if at else text


def visual_form_spans(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The form, and (start, end in the form, start, end in the text) of each spliced segment."""
    if text.isascii():
        return text, []
    if _has_kept_joiner(text):
        form = _segment(text)
        return form, [(0, len(form), 0, len(text))]
    parts, spans, at, size = [], [], 0, 0
    for a, b in _segments(text, 0):
        form = _canonical(text[a:b])
        parts += [text[at:a], form]
        size += a - at
        spans.append((size, size + len(form), a, b))
        size += len(form)
        at = b
    return "".join([*parts, text[at:]]), spans


def original_offset(spans: list[tuple[int, int, int, int]], at: int, end: bool = False) -> int:
    """The offset in the text of an offset in the form; inside a segment its start, or its end if asked."""
    shift = 0
    for a, b, c, d in spans:
        if at < a or (at == a and not end and a != b):
            if at < a:
                break
        if at < b or (end and at == b):
            inner = at - a
            if b - a == d - c:
                return c + inner
            return d if end else c
        shift = d - b
    return at + shift


def form_column(text: Column) -> Column:
    """Column function of the form."""

    @pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(visual_form, na_action="ignore")

    return form(text)


def visual_forms(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """All columns of df and the consistent form of one; a column of the form's name is replaced."""
    return df.withColumn(form, form_column(F.col(text)))


#: Rows of a text with many copies are spread over so many salts.
SALTS = 16


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key_a < key_b) of rows whose texts differ as stored and are equal in the consistent form.

    Texts are compared by their 128-bit digests, so that no text is shuffled. Rows of equal text form one class;
    only classes of groups with at least two classes are paired, class with class, and then expanded to rows by
    salted joins: copies of one text are never paired with each other, nor gathered.

    Null, empty and blank texts (blank in the form) are in no pair; rows with a null key neither.
    """
    rows = cut(
        df.select(F.col(key).alias("id"), F.col(text).alias("t"))
        .where("id is not null and t is not null")
        .withColumn("f", form_column(F.col("t")))
        .where(F.length(F.regexp_replace("f", r"(?U)[\s\p{Cntrl}]+", "")) > 0)
        .select("id", F.unhex(F.md5("f")).alias("f"), F.unhex(F.md5("t")).alias("t"))
    )
    classes = rows.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("f").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("f")
    # rows of groups with at least two classes are used four times
    rows = cut(rows.join(mixed, "f", "left_semi"))
    classes = rows.select("f", "t").distinct()
    a, b = (classes.select("f", F.col("t").alias(f"t_{x}")) for x in "ab")
    # the variants of one form are split over salts on one side, so that no task pairs all of them
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    a, b = a.withColumn("salt", F.pmod(F.xxhash64("t_a"), F.lit(SALTS))), b.withColumn("salt", salted)
    pairs = a.join(b, ["f", "salt"]).where("t_a < t_b").select("t_a", "t_b")
    left = rows.select(F.col("t").alias("t_a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    right = rows.select(F.col("t").alias("t_b"), F.col("id").alias("y"))
    return (
        pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        .join(left, ["t_a", "salt"])
        .select("t_b", "x", F.pmod(F.xxhash64("x"), F.lit(SALTS)).alias("salt"))
        .join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["t_b", "salt"])
        .select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    )
