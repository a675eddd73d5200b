"""Column helpers for text: trimming, normalising, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def any_of(text: Column, patterns: list[str], whole: bool = False, flags: str = "(?Ud)") -> Column:
    """Whether one of the patterns is found (whole: matches all of text)."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(f"{flags}^(?:{joined})\\z" if whole else f"{flags}{joined}")


#: What (?U)[\s\x1c-\x1f] matches.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def uni_trim(text: Column) -> Column:
    """Strips white space of any kind, without a regular expression: that would look at every place of the text."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def trimmed(name: str) -> Column:
    """uni_trim of a column (by name, as it is read several times): first and last character tell most texts that need none."""
    text = F.col(name)
    ordinary = lambda end: F.ascii(end).between(0x21, 0x7E) | (F.ascii(end) > 0x3000)
    return F.when(ordinary(text) & ordinary(F.substring(text, -1, 1)), text).otherwise(uni_trim(text))


def collapse_space(text: Column) -> Column:
    return uni_trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def nonblank_or(text: Column, default: Column | str) -> Column:
    """The trimmed text, or the default for null and blank ones."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(uni_trim(text), F.lit("")), other)


def plain(text: Column) -> Column:
    """Trimmed; null is empty."""
    return F.coalesce(uni_trim(text), F.lit(""))


def truncated(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def normalize_characters(text: Column) -> Column:
    """Odd characters of extracted text made plain: one translate for all of them."""
    odd, usual = zip(*fixed.CHARACTERS.items(), strict=True)
    return F.translate(text, "".join(odd), "".join(usual))


def normalize_breaks(text: Column) -> Column:
    """Unix line ends, runs of three or more of them cut to two, trimmed."""
    return uni_trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n"))


def normalize_name(name: Column) -> Column:
    """White space folded, a leading enumerator dropped, at most 120 characters."""
    folded = collapse_space(name)
    return truncated(F.regexp_replace(folded, r"(?U)^[一二三四五六七八九十\d]+[、.．]\s*", ""), fixed.NAME_TEXT)


def meaningful_chars(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(fixed.MEANINGFUL)), F.lit(0))


def slug(title: Column) -> Column:
    """A title as part of an id: other characters than word characters and hyphens as underscores, at most 40."""
    made = F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w一-鿿-]+", "_"), r"^_+|_+\z", "")
    return truncated(made, fixed.SLUG_LENGTH)
