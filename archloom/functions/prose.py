"""What a paragraph is: record sheet, cast table, quotation, question, note or prose, as columns of markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SOURCE = r"^\((?:[^()]|\([^()]*\))*\)$"
_LABEL = r"^\*\*[^*]+:\*\*"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def source_of(text: Column) -> Column:
    """(source, year) of a last line wholly in parentheses below a body; the year is the last that it names."""
    x = lines(text)
    last = F.get(x, F.size(x) - 1)
    year = F.get(F.reverse(F.regexp_extract_all(last, F.lit(r"\b((?:1[6-9]|20)\d{2})\b"), F.lit(1))), 0)
    return F.when((F.size(x) > 1) & last.rlike(_SOURCE), F.struct(F.substr(last, F.lit(2), F.char_length(last) - 2).alias("source"), year.cast("int").alias("year")))


def is_record(text: Column) -> Column:
    """Two bold labels or more."""
    x = lines(text)
    return (F.size(F.filter(x, lambda v: v.rlike(_LABEL))) >= 2) & F.get(x, 0).rlike(_LABEL)


def record_values(text: Column) -> Column:
    """Label and value of each entry; a line without a label goes on with the value above."""
    start = F.array().cast("array<struct<label:string,value:string>>")

    def step(acc: Column, line: Column) -> Column:
        labelled = line.rlike(_LABEL)
        new = F.struct(F.regexp_extract(line, r"^\*\*([^*]+):\*\*", 1).alias("label"), F.trim(F.regexp_replace(line, _LABEL, "")).alias("value"))
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["label"].alias("label"), F.concat(last["value"], F.lit(" "), line).alias("value"))
        return F.when(labelled, F.concat(acc, F.array(new))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)

    return F.aggregate(lines(text), start, step)


def cast_header(text: Column) -> Column:
    """The place of the line that is just two bold words, null if there is none with a row below."""
    x = lines(text)
    at = F.array_position(F.transform(x, lambda v: v.rlike(r"^\*\*\S+\*\*\s+\*\*\S+\*\*$")), True)
    return F.when((at > 0) & (at < F.size(x)), at.cast("int") - 1)


def is_question(text: Column) -> Column:
    return F.get(lines(text), 0).rlike(r"^\*\*[^*]*\?\*\*$") & (F.size(lines(text)) > 1)


def is_note(text: Column) -> Column:
    """All in italics."""
    rest = F.regexp_replace(F.regexp_replace(text, r"\*\*[^*]+\*\*", "x"), r"\*[^*]+\*", "")
    return text.rlike(r"\*[^*]+\*") & ~rest.rlike(r"[\p{L}\p{N}]")


def has_caption(next_line: Column, credit: str) -> Column:
    """The next line that isn't blank is in italics and no credit."""
    return next_line.rlike(r"^\*[^*].*\*") & ~F.trim(F.replace(next_line, F.lit("*"), F.lit(""))).rlike(credit)


def kind(text: Column) -> Column:
    """The first that holds of: record, cast, quotation, question, extract, note; else prose.

    A quotation begins with a quotation mark. Other text is an extract where its source is shorter than it.
    """
    source = source_of(text)["source"]
    body = F.char_length(F.regexp_replace(F.array_join(lines(text), ""), r"[*]", "")) - F.char_length(source) - 2
    extract = F.coalesce(F.char_length(source) < body, F.lit(False))
    quoted = F.ltrim(F.regexp_replace(text, "[*]", "")).rlike('^["“]')
    return F.when(is_record(text), "record").when(cast_header(text).isNotNull(), "cast").when(quoted, "quotation").when(is_question(text), "question").when(extract, "extract").when(is_note(text), "note").otherwise("prose")
