"""Text functions as column expressions.

White space is what Unicode and Python call so: Java's ``\\s`` knows only six of those characters. Unicode normal forms have no
built-in; they are Arrow functions over whole batches, and everything around them stays in the JVM.

Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
# ---- Fixed values -----------------------------------------------------------------------------------------------------
BULLETS = ("-", "–", "+", "●", "•", "*")
HEADING = r"^\s*([IVXLCDM]{1,7})\s*\.\s*(.+)$"
SECTION_START = r"^\s*(?:[IVXLCDM]{1,7}\.|[-–+●•*])"
SUBSET_PREFIX = r"^[A-Z]{6}\+"
LABEL_TRIM = " .:;,-"
UNNAMED = "unnamed_field"
# ---- end of fixed values ----------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _normal_form(form: str):
    @arrow_udf(StringType())
    def convert(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return convert


@arrow_udf(StringType())
def _without_marks(texts: pa.Array) -> pa.Array:
    def strip(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))

    return pa.array([t if t is None or t.isascii() else strip(t) for t in texts.to_pylist()], pa.string())


def _ranges(points: list[int]) -> str:
    """Code points as a character class for Java's patterns."""
    out, start = [], None
    for p, after in zip(points, [*points[1:], -1], strict=True):
        start = p if start is None else start
        if after != p + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{p:x}}}")
            start = None
    return "".join(out)


#: Every code point with a combining class above 0, by rule from the Unicode data at hand. Java has no such class of its own.
COMBINING = _ranges([p for p in range(0x300, 0x1F000) if unicodedata.combining(chr(p))])


@arrow_udf(DoubleType())
def _round_half_even(values: pa.Array, digits: pa.Array) -> pa.Array:
    return pa.array([None if v is None else round(v, d) for v, d in zip(values.to_pylist(), digits.to_pylist(), strict=True)], pa.float64())


_nfc, _nfd = _normal_form("NFC"), _normal_form("NFD")


def nfc(c: Column | str) -> Column:
    """The composed form."""
    return _nfc(_col(c))


def nfd(c: Column | str) -> Column:
    """The decomposed form."""
    return _nfd(_col(c))


def starts_combining(c: Column | str) -> Column:
    """Whether the first code point joins the character before it (combining class above 0)."""
    return F.coalesce(_col(c).rlike(f"^[{COMBINING}]"), F.lit(False))


def binary_round(c: Column | str, digits: int) -> Column:
    """Rounding of the stored binary number, half to even: Spark's own rounds the shortest decimal, half up."""
    return _round_half_even(_col(c).cast("double"), F.lit(digits))


def is_blank(c: Column | str) -> Column:
    """Nothing but white space."""
    return _col(c).rlike(f"^{WS}*$")


def stripped(c: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def squeezed(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def comparable_form(c: Column | str) -> Column:
    """Decomposed, without white space: for comparing what two readers read."""
    return F.regexp_replace(nfd(c), f"{WS}+", "")


def searchable(c: Column | str) -> Column:
    """Composed, white space squeezed."""
    return squeezed(nfc(c))


def collapsed(c: Column | str) -> Column:
    """Composed, without white space."""
    return F.replace(searchable(c), F.lit(" "), F.lit(""))


def comparable_label(c: Column | str) -> Column:
    """Without accents, lower case, đ as d, white space squeezed, no punctuation at the ends."""
    bare = F.replace(F.lower(_without_marks(_col(c))), F.lit("đ"), F.lit("d"))
    return F.btrim(squeezed(bare), F.lit(LABEL_TRIM))


def slug(c: Column | str) -> Column:
    """The label as a key; ``unnamed_field`` where nothing is left."""
    s = F.btrim(F.regexp_replace(comparable_label(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", UNNAMED).otherwise(s)


def blankless_lower(c: Column | str) -> Column:
    """Composed, plain blanks removed (only those), lower case."""
    return F.lower(F.replace(nfc(c), F.lit(" "), F.lit("")))


def font_key(c: Column | str) -> Column:
    """A font's name without slashes before it and subset prefix, lower case."""
    return F.lower(F.regexp_replace(F.ltrim(_col(c), F.lit("/")), SUBSET_PREFIX, ""))


def without_prefixes(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Each prefix taken off once, in order, with the blanks after it: one pattern of optional prefixes."""
    if not prefixes:
        return c
    return F.regexp_replace(c, "^" + "".join(f"(?:\\Q{p}\\E *)?" for p in prefixes), "")


def sourced_text(c: Column | str, prefixes: tuple[str, ...] = ()) -> Column:
    """The text of a value: squeezed, prefixes off; null where nothing is left."""
    return F.nullif(without_prefixes(squeezed(c), prefixes), F.lit(""))


def fragment_text(c: Column | str) -> Column:
    """A fragment without bullets and label separator."""
    return without_prefixes(squeezed(c), (*BULLETS, ":"))


def heading_number(c: Column | str) -> Column:
    """The Roman number of a section heading; null if it is none."""
    return F.nullif(F.regexp_extract(stripped(c), HEADING, 1), F.lit(""))


def heading_rest(c: Column | str) -> Column:
    """What follows the number of a heading; null if it is none."""
    return F.nullif(F.regexp_extract(stripped(c), HEADING, 2), F.lit(""))


def heading_title(c: Column | str) -> Column:
    """A heading's title: what stands before the first colon."""
    return stripped(F.split_part(heading_rest(c), F.lit(":"), F.lit(1)))


def heading_inline(c: Column | str) -> Column:
    """The value on a heading's own line: what follows the first colon; null if blank."""
    rest = heading_rest(c)
    return F.when(F.contains(rest, F.lit(":")), F.nullif(squeezed(F.substr(rest, F.locate(":", rest) + 1)), F.lit("")))


def starts_with_bullet(c: Column | str) -> Column:
    return stripped(c).substr(1, 1).isin(*BULLETS)


def is_bare_bullet(c: Column | str) -> Column:
    return stripped(c).isin(*BULLETS)


def looks_like_label(c: Column | str, most_words: int = 6, allow_long: Column | bool = False) -> Column:
    """A short text that starts with a capital or a digit; bullets before it don't count."""
    text = stripped(F.btrim(stripped(c), F.lit("".join(BULLETS))))
    long = F.lit(allow_long) if isinstance(allow_long, bool) else allow_long
    return (text != "") & (long | (F.size(F.split(text, f"{WS}+")) <= most_words)) & text.rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]")


def looks_like_docx_label(c: Column | str, has_value: Column, most_words: int = 8) -> Column:
    """As before, but a long label passes with a value after it and no digit in it."""
    text = stripped(c)
    short = F.size(F.split(text, f"{WS}+")) <= most_words
    return (text != "") & (short | (has_value & ~text.rlike(r"\p{Nd}"))) & text.rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]")


def joined_number(lines: Column | str) -> Column:
    """Lines of a cell joined without a blank, so that a wrapped number stays one."""
    return F.array_join(_col(lines), "")


def joined_prose(lines: Column | str) -> Column:
    """Lines joined with a blank, but after a hyphen."""
    return F.aggregate(_col(lines), F.lit(""), lambda a, x: F.when(a == "", x).when(F.endswith(a, F.lit("-")), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


def original_position(text: Column | str, position: Column) -> Column:
    """The index in a text of the ``position``-th character that isn't white space (from 0); its length if there are fewer."""
    chars = F.split(_col(text), "")
    at = F.filter(F.transform(chars, lambda ch, i: F.when(ch.rlike(f"^{WS}$"), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(at, position.cast("int") + 1), F.length(_col(text)))
