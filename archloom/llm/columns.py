"""Column helpers that the native operators share. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_spaces(text: Column) -> Column:
    """The text's characters that belong to words."""
    return F.translate(text, SPACES, "")


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than space and 0x09-0x0D."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The text split at line feeds, empty lines included."""
    return F.split(text, "\n", -1)


def has_word(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES)) != ""


def word_count(text: Column) -> Column:
    """The number of words, without building them all: gaps of white space in the trimmed text."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit("[\\x20\\x09-\\x0D]+")) + 1)
