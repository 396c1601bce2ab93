"""Text normalisation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Unicode white space as in Python: what (?U)\s misses are the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Line breaks that JSON lines readers stumble over, and NUL.
LINE_BREAKS = "  \u0085\x00"
SEPARATOR = "\x1f"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def strip_long(x: Column) -> Column:
    """``strip`` of a column of long texts: only those that begin or end in white space are searched."""
    return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(SPACE), strip(x)).otherwise(x)


def collapse(x: Column) -> Column:
    """One line: runs of white space become a space."""
    return strip(F.regexp_replace(x, f"{SPACE}+", " "))


def clean(x: Column) -> Column:
    return strip(F.translate(x, LINE_BREAKS, " " * len(LINE_BREAKS)))


def key(*parts: Column) -> Column:
    """Content key: case and white space don't make two texts different."""
    return F.concat_ws(SEPARATOR, *[F.lower(collapse(p)) for p in parts])


def norm_text(x: Column) -> Column:
    return F.regexp_replace(key(x), "[.?! ]+$", "")


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def title(x: Column) -> Column:
    """First letters of words raised; the rest stays."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def named(name: Column, description: Column) -> Column:
    """"name: description", or the name alone; both on one line."""
    desc = F.when(collapse(description) != "", collapse(description))
    return F.concat_ws(": ", collapse(name), desc)


def styled(raw: Column, name: Column, style: Column) -> Column:
    return F.when(style == "raw", raw).when(style == "title", title(name)).otherwise(name)


def lower_first(x: Column, safe: list[str]) -> Column:
    """First letter lowered if the first word is one that may begin in lower case."""
    first = F.split_part(x, F.lit(" "), F.lit(1))
    plain = F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substr(first, F.lit(2))))
    return F.when(F.lower(first).isin(safe) & (first == plain), F.concat(F.lower(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))).otherwise(x)


def clause(x: Column, safe: list[str]) -> Column:
    return lower_first(strip(F.regexp_replace(strip(x), r"[.!… ]+$", "")), safe)


def trigrams(x: Column) -> Column:
    """Distinct character trigrams of the lower-case name, padded with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(x), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def token_proxy(x: Column) -> Column:
    """Tokens by characters: 2.2 a token and three around."""
    return tokens_of(F.length(x))


def tokens_of(length: Column) -> Column:
    """``token_proxy`` of a text that has so many characters."""
    return F.ceil(length / F.lit(2.2)) + 3


def has_control_text(x: Column) -> Column:
    return F.contains(x, F.lit("<|"))


def unescaped(text: str | None) -> str | None:
    """Literal \\uXXXX sequences as characters, surrogate pairs joined, halves that stand alone replaced. ``unescape`` does the same in columns."""
    if text is None or "\\u" not in text:
        return text
    units = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def unescape(x: Column) -> Column:
    """``unescaped`` as an expression: runs of escapes are read as UTF-16, after halves of pairs that stand alone."""
    escape, high, low = r"\\u[0-9a-fA-F]{4}", r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"

    def joined(t: Column) -> Column:
        whole = F.regexp_replace(t, f"{high}(?!{low})|(?<!{high}){low}", "\ufffd")
        runs = F.transform(F.regexp_extract_all(whole, F.lit(f"(?:{escape})++"), F.lit(0)), lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        return F.array_join(F.zip_with(F.split(whole, f"(?:{escape})++"), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(x, lambda t: F.when(F.contains(t, F.lit("\\u")), joined(t)).otherwise(t))


def truncate_left(x: Column, limit: int, mark: str = "…") -> Column:
    """The end of a text, with a mark where it was cut."""
    return F.when(F.length(x) > limit, F.concat(F.lit(mark), F.right(x, F.lit(limit - len(mark))))).otherwise(x)


def neutralise(x: Column) -> Column:
    """Breaks control marks <|...|> in user text: a blank between their two characters leaves none."""
    return F.regexp_replace(F.regexp_replace(x, r"<\|", "< |"), r"\|>", "| >")
