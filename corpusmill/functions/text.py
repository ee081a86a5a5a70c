"""Text columns: decoding, line splitting, stripping, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: white space and line breaks ---------------------------------
STRIP_CLASS = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BREAK_CLASS = r"\n-\r\x1c-\x1e\x85\u2028\u2029"
BREAKS_OTHER_THAN_LF = (
    "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029",
)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, rf"^[{STRIP_CLASS}]+|[{STRIP_CLASS}]+\z", "")


def decode_text(content: Column) -> Column:
    """Bytes to text; bytes that are not valid UTF-8 are dropped, CR and CRLF
    become LF."""
    valid = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(valid, r"\r\n?", "\n")


def is_binary(content: Column, sniff_bytes: int) -> Column:
    """A NUL within the first ``sniff_bytes`` bytes."""
    return F.position(F.unhex(F.lit("00")), F.substring(content, 1, sniff_bytes)) > 0


def physical_lines(content: Column) -> Column:
    """Newline bytes, plus one for a last line without newline."""
    raw = content.cast("string")
    newlines = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"), F.lit("")))
    open_tail = (F.octet_length(raw) > 0) & ~raw.endswith("\n")
    return (newlines + open_tail.cast("int")).cast("bigint")


def with_lf_breaks(text: Column) -> Column:
    """Every kind of line break turned into LF.

    Plain replacements, not a regular expression: a character class with
    look-behind is ten times slower per character.
    """
    for line_break in BREAKS_OTHER_THAN_LF:
        text = F.replace(text, F.lit(line_break), F.lit("\n"))
    return text


def text_lines(text: Column) -> Column:
    """Lines at every kind of break.  Text that ends in a break yields one more,
    empty, element; see ``line_count``."""
    return F.split(with_lf_breaks(text), "\n")


def line_count(lines: Column) -> Column:
    """Number of lines in ``text_lines`` output."""
    open_tail = (F.element_at(lines, -1) != "").cast("int")
    return (F.size(lines) - 1 + open_tail).cast("bigint")


def lines_with_breaks(text: Column) -> Column:
    """Lines of decoded text, each with its terminator."""
    return F.filter(F.split(text, rf"(?<=[{BREAK_CLASS}])"), lambda line: line != "")


def newline_lines(text: Column) -> Column:
    """Lines separated by LF; a final newline does not open another line."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def collapse_space(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.regexp_replace(strip(text), rf"[{STRIP_CLASS}]+", " ")


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def short_error(text: Column, chars: int = 300) -> Column:
    """One-line error text, cut with "..." when it is long."""
    flat = collapse_space(text)
    return F.when(F.length(flat) <= chars, flat).otherwise(
        F.concat(F.substring(flat, 1, chars), F.lit("..."))
    )


def error_lines(stderr: Column, tail: int = 5) -> Column:
    """Lines that begin with ``ERROR:``; without any, the last few lines."""
    lines = F.transform(
        lines_with_breaks(F.regexp_replace(stderr, r"\r\n?", "\n")),
        lambda line: F.regexp_replace(line, rf"[{BREAK_CLASS}]\z", ""),
    )
    errors = F.filter(lines, lambda line: line.rlike(rf"^[{STRIP_CLASS}]*ERROR:"))
    last = F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), tail)
    return F.array_join(F.when(F.size(errors) > 0, errors).otherwise(last), "\n")
