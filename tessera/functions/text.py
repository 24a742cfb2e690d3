"""Scalar text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and constants that results depend on.
TOKEN = r"[\p{L}\p{N}_]+"
ENTITY_PREFIX = "en.wikipedia.org/wiki/"
BRACKET_NUMBER = r"\[([0-9]+)\]"
PARAGRAPH = r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"
ARTICLE_LIMIT = 1_000_000
HEADING = r"={2,}[\p{L}\p{N}_ |:–]+={2,}"
PRONUNCIATION = r"/[^\n]*[\x{0250}-\x{02FF}][^\n]*/"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: the tokenizer that stands in for a language model's."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def normalize_form(mention: Column) -> Column:
    """Short mentions (under 4 characters) stay; others turn to upper case."""
    return F.when(F.length(mention) < 4, mention).otherwise(F.upper(mention))


def fix_upper_case(phrase: Column) -> Column:
    """A phrase in capitals becomes capitalised words joined by blanks; others stay."""
    words = F.regexp_extract_all(F.lower(phrase), F.lit(f"({TOKEN})"), F.lit(1))
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return F.when(phrase == F.upper(phrase), F.array_join(capital, " ")).otherwise(phrase)


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.encode("latin-1", "backslashreplace").decode("unicode-escape"))


def unescape_entity(entity: Column) -> Column:
    r"""Decode ``\uXXXX``; rows without a backslash never leave the JVM."""
    return F.when(F.contains(entity, F.lit("\\")), _unescaped(F.when(F.contains(entity, F.lit("\\")), entity))).otherwise(entity)


def text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def add_prefix(entity: Column) -> Column:
    return F.concat(F.lit(ENTITY_PREFIX), entity)


def strip_prefix(entity: Column) -> Column:
    return F.replace(entity, F.lit(ENTITY_PREFIX), F.lit(""))


def normalize_mention(s: Column) -> Column:
    """Lower case, cut at the first bracket, trimmed, other runs to one underscore."""
    return F.regexp_replace(F.trim(F.substring_index(F.lower(s), "(", 1)), "[^a-zA-Z0-9_]+", "_")


def normalize_entity(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[_().\" ,/']+", " "))


def reflow(text: Column) -> Column:
    """Line ends inside paragraphs become blanks; a blank line ends a sentence."""
    joined = F.replace(text, F.lit("-\n"), F.lit("-"))
    marked = F.replace(joined, F.lit("\n\n"), F.lit("\u0001"))
    return F.trim(F.replace(F.replace(marked, F.lit("\n"), F.lit(" ")), F.lit("\u0001"), F.lit(".\n\n")))


def strip_markup(text: Column) -> Column:
    """Without plain headings and pronunciations; three line ends become one.

    A heading holds words, blanks, bars, dashes and colons only; a pronunciation goes from a line's
    first slash to its last and counts only with a phonetic letter between them.
    """
    out = F.regexp_replace(text, HEADING, "")
    out = F.regexp_replace(out, PRONUNCIATION, "")
    return F.replace(out, F.lit("\n\n\n"), F.lit("\n"))


def html_paragraphs(html: Column) -> Column:
    """Text of all paragraphs, tags and bracketed numbers dropped, one to a line."""
    inner = F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1))
    return F.regexp_replace(F.regexp_replace(F.array_join(inner, "\n"), "<[^>]*>", ""), BRACKET_NUMBER, "")


def first_article(*sources: Column) -> Column:
    """The first source that is not empty, cut at the article limit."""
    return F.substring(F.coalesce(*(F.nullif(s, F.lit("")) for s in sources)), 1, ARTICLE_LIMIT)


def log_numbers(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"([.0-9]+)"), F.lit(1))
