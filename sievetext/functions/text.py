"""Text expressions.  Everything here stays in the JVM as built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/strip() treat as whitespace.
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The Unicode White_Space property (no \x1c-\x1f), used when trimming anchors.
UNICODE_WHITESPACE = (
    "\t\n\v\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The line boundaries of Python's str.splitlines().
LINE_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"


def _char_class(chars: str) -> str:
    """A character class with neighbours as ranges, which match faster than a list."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{lo:x}}}" + (f"-\\x{{{hi:x}}}" if hi > lo else "") for lo, hi in spans) + "]"


# A run of whitespace and commas, except the single space, which stays as it is.  With
# (?U) \s is the Unicode property, one test instead of a list; \x1c-\x1f complete it.
UNTIDY_RUN = r"(?U)(?:[\s,\x1c-\x1f&&[^ ]]| [\s,\x1c-\x1f])[\s,\x1c-\x1f]*+"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
LINE_BREAK = _char_class(LINE_BREAKS)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def decode_lossy(content: Column) -> Column:
    """Bytes to text; every invalid UTF-8 sequence becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{feff}", "")


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.trim(text, F.lit(chars))


def normalize_text(text: Column) -> Column:
    """Commas and every whitespace run become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text_or_empty(text), UNTIDY_RUN, " "))


def split_lines(text: Column) -> Column:
    """All lines of a text as they are, blank ones too."""
    return F.split(text, LINE_BREAK)


def is_blank(text: Column) -> Column:
    return ~text_or_empty(text).rlike(NOT_BLANK)


def clean_output_text(text: Column) -> Column:
    return F.translate(text_or_empty(text), '\n"', " '")


def render_line(filename: Column, category: Column, text: Column) -> Column:
    """``filename : category : "text"``, nothing else is quoted."""
    return F.concat(filename, F.lit(" : "), category, F.lit(' : "'), clean_output_text(text), F.lit('"'))


def render_scored_line(category: Column, score: Column, text: Column) -> Column:
    """The documented form of a result: category, score with four digits, text.

    A score halfway between two values is rounded to the even one.
    """
    return F.format_string('%s : %.4f : "%s"', category, F.bround(score, 4), clean_output_text(text))


def fallback_category(query: Column, length: int = 20) -> Column:
    """Spaces to underscores, lower case, then the first ``length`` characters."""
    return F.substring(F.lower(F.replace(query, F.lit(" "), F.lit("_"))), 1, length)


def repeat_anchor(query: Column, num: int) -> Column:
    return F.array_repeat(query, num)


def defaulted(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def trim_and_compact(cells: Column) -> Column:
    """Trim every cell, drop the blank ones."""
    return F.filter(
        F.transform(cells, lambda cell: strip(cell, UNICODE_WHITESPACE)),
        lambda cell: cell != "",
    )


def longest_field(cells: Column) -> Column:
    """0-based position of the longest cell; the leftmost one wins ties; null if there is none."""
    ranked = F.transform(
        cells, lambda cell, i: F.struct(F.length(text_or_empty(cell)).alias("size"), (-i).alias("back"))
    )
    return -F.array_max(ranked)["back"]


def column_index_from_name(name: Column) -> Column:
    """The last character of the file stem when it is an ASCII digit, else null."""
    base = F.substring_index(name, "/", -1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.nullif(F.regexp_extract(stem, "([0-9])$", 1), F.lit("")).cast("int")
