"""Published documents: front matter and body in, validated rows and files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(id, front, body) of the markdown files below a folder; the root's id is ``welcome``."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    return split_front(raw, F.col("path"), folder)


#: The front matter between the fences of a document's first lines, and the body below them.
_FENCED = r"(?s)^\x{FEFF}?---[ \t]*\r?\n(.*?)(?:^|(?<=\n))---[ \t]*(?:\r?\n|$)(.*)$"


def split_front(raw: DataFrame, path: Column, folder: str) -> DataFrame:
    """``raw`` (value) split at its ``---`` fences; id from the path below ``folder``.

    A document that doesn't begin with a fence, or whose fence isn't closed, is all body and its front is null.
    """
    fenced = F.col("value").rlike(_FENCED)
    root = folder.rstrip("/") + "/"
    at = F.instr(path, root)
    below = F.when(at > 0, F.substr(path, at + F.lit(len(root)))).otherwise(path)
    name = F.regexp_replace(F.regexp_replace(below, r"\.md$", ""), "(^|/)index$", "")
    front, body = (F.regexp_extract("value", _FENCED, i) for i in (1, 2))
    return raw.select(F.when(name == "", "welcome").otherwise(name).alias("id"), F.when(fenced, front).alias("front"), F.when(fenced, body).otherwise(F.coalesce("value", F.lit(""))).alias("body"))


_QUOTED = r'"((?:[^"\\]|\\.)*)"'


def unquoted(text: Column) -> Column:
    """What stands in a quoted value, escapes read; other values as they are."""
    inner = F.concat(F.lit('["'), F.regexp_extract(text, f"^{_QUOTED}$", 1), F.lit('"]'))
    read = F.get(F.from_json(inner, "array<string>", {"allowUnquotedControlChars": "true"}), 0)
    return F.when(text.rlike(f"^{_QUOTED}$"), F.coalesce(read, text)).otherwise(text)


def front_field(name: str) -> Column:
    """A quoted or bare one-line value of the front matter; null where it is absent or empty."""
    return F.nullif(unquoted(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(\S.*?)[ \t\r]*$", 1)), F.lit(""))


def front_list(name: str) -> Column:
    """The items of a list of the front matter, each on its own line; null where the list is absent."""
    lines = F.regexp_extract("front", rf"(?m)^{name}:[ \t\r]*\n((?:[ \t]*- .*(?:\n|\Z))+)", 1)
    items = F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*- (.*?)[ \t\r]*$"), F.lit(1))
    return F.when(lines != "", F.transform(items, unquoted))


def route_map(docs: DataFrame) -> DataFrame:
    """(source, route): where each old url is now; ``docs``: id, front."""
    return docs.select(F.regexp_replace(front_field("source"), "/$", "").alias("source"), F.concat(F.lit("/"), "id").alias("route")).where("source is not null")


def validate(docs: DataFrame) -> DataFrame:
    """``docs`` (title, source, year, categories) with ``errors`` and default categories; rows with errors are for quarantine."""
    tests = [
        (F.coalesce(F.trim("title"), F.lit("")) == "", "title is empty"),
        (F.col("source").isNotNull() & ~F.col("source").rlike(r"^https?://[^\s/]+"), "source is no url"),
        (F.col("year").isNotNull() & ~F.col("year").between(1950, 2100), "year is out of range"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(say)) for bad, say in tests]))
    return docs.withColumn("errors", errors).withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def to_markdown(docs: DataFrame) -> DataFrame:
    """(id, markdown): front matter from a map of strings (``fields``) and one of lists (``lists``, if there is one), then the body.

    Null values and empty lists are left out.
    """

    def quoted(v: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            v = F.replace(v, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), v, F.lit('"'))

    fields = F.filter(F.array_sort(F.map_entries("fields")), lambda e: e["value"].isNotNull())
    lines = F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"])))
    if "lists" in docs.columns:
        lists = F.filter(F.array_sort(F.map_entries("lists")), lambda e: F.size(e["value"]) > 0)
        lines = F.concat(lines, F.transform(lists, lambda e: F.concat(e["key"], F.lit(":\n"), F.array_join(F.transform(e["value"], lambda x: F.concat(F.lit("  - "), quoted(x))), "\n"))))
    return docs.select("id", F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``validate`` to publish, and those for quarantine with what is wrong with them."""
    return docs.where(F.size("errors") == 0).drop("errors"), docs.where(F.size("errors") > 0)


def write_documents(docs: DataFrame, folder: str, *, part: str | None = None) -> None:
    """All documents, or with ``part`` only those of the partitions that ``docs`` holds: others stay as they are."""
    if part is None:
        docs.write.mode("overwrite").parquet(folder)
    else:
        docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)
