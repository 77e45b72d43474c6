"""Quality rules: base statistics of each text, and lines that too many documents of a host carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.columns import has_word, let, lines, without_spaces, word_count, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def normal_line(line: Column) -> Column:
    """A line as it is compared: trimmed, lower case, digits as 0."""
    return F.translate(F.lower(F.trim(line, F.lit(" \t\x0b\x0c\r"))), "123456789", "000000000")


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more among ``tokens``."""

    def covered(hashes: Column) -> Column:
        # equal windows stand side by side once sorted; then gaps between the starts give the union
        in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            in_order,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    found = let(tokens, lambda w: F.when(F.size(w) > size, let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0))
    return F.coalesce(found, F.lit(0))


def base_columns(text: Column) -> dict[str, Column]:
    """The five base statistics of a text that isn't null."""
    bare = without_spaces(text)
    full = F.filter(lines(text), has_word)
    return {
        "n_words": word_count(text).cast("long"),
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words(text)).cast("long"),
    }


def frequent_lines(rows: DataFrame, *, max_share: float, max_docs: int, min_docs: int, copies_count: bool = False) -> DataFrame:
    """(host, line) of the line hashes in more than ``max_share`` of the host's documents, or in more than ``max_docs``, but in ``min_docs`` at least.

    ``rows``: _id, host, text_key, line. A document is a text, so that a much copied one doesn't turn its own
    lines into boilerplate, or with ``copies_count`` an id and a text. Both counts combine before the shuffle.
    """
    document = ["text_key", "_id"] if copies_count else ["text_key"]
    once = rows.select("host", "line", *document).distinct()
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = rows.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where((F.col("n_docs") > F.lit(max_share) * F.col("host_docs")) | (F.col("n_docs") > max_docs)).select("host", "line")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = 0.01, max_docs: int = 1000, min_docs: int = 20, min_left: float = 0.3, copies_count: bool = False, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: base statistics, lines removed, and whether the document stays.

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_removed_lines, n_removed_words; ``with_text`` adds clean_text: the text without its frequent lines; ``carry`` adds those columns of
    ``docs`` as the struct ``row``.)

    A line is removed where more than ``max_share`` of its host's documents hold it, or more than
    ``max_docs``, whatever their share, but ``min_docs`` at least. Exact copies count as one document there, with
    ``copies_count`` each by its id. A document is depleted, and rejected, where fewer than ``min_left`` of its words
    are left. A null text is an empty one and fails the base rules; null hosts are one host.
    Rows with equal id, host and text are one document: they get equal verdicts, each with that
    document's own counts. Other columns are ignored.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *([F.struct(*carry).alias("row")] if carry else []))
    read = read.withColumn("text_key", F.xxhash64("_text"))
    parts = F.transform(F.filter(lines(F.col("_text")), has_word), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), word_count(x).alias("words")))
    rows = read.select("_id", "host", "text_key", F.posexplode(parts).alias("pos", "x")).select("_id", "host", "text_key", "pos", "x.line", "x.words")
    often = frequent_lines(rows, max_share=max_share, max_docs=max_docs, min_docs=min_docs, copies_count=copies_count)
    hit = rows.join(often, ["host", "line"])
    # a set, so that a document that stands in several rows has each of its lines once
    gone = hit.groupBy("_id", "host", "text_key").agg(F.collect_set(F.struct("pos", "line", "words")).alias("g"))
    removed = gone.select("_id", "host", "text_key", F.size("g").cast("long").alias("n_removed_lines"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("n_removed_words"), *([F.array_distinct("g.line").alias("_gone")] if with_text else []))
    stats = read.select("_id", "host", "text_key", *[c.alias(k) for k, c in base_columns(F.col("_text")).items()], F.size(lines(F.col("_text"))).cast("long").alias("n_lines"), *(["_text"] if with_text else []), *(["row"] if carry else []))
    keys = ["_id", "host", "text_key"]
    other = removed.select(*[F.col(k).alias(f"r_{k}") for k in keys], "n_removed_lines", "n_removed_words", *(["_gone"] if with_text else [])).hint("shuffle_hash")
    out = stats.join(other, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    out = out.withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)), "n_removed_words": gone.cast("long"), "base_failed": failed})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.lit(min_left) * F.col("n_words")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "n_removed_words"]
    if with_text:
        left = F.filter(lines(F.col("_text")), lambda x: ~has_word(x) | ~F.array_contains(F.col("_gone"), F.xxhash64(normal_line(x))))
        out = out.withColumn("clean_text", F.when(F.col("n_removed_lines") > 0, F.array_join(left, "\n")).otherwise(F.col("_text")))
        names.append("clean_text")
    if carry:
        names.append("row")
    return out.select(F.col("_id").alias(id_col), *names)


#: The same rows from DuckDB. Hashes are compared as the lines themselves.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS all_lines,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d
), win AS (
  SELECT doc_id, host, text, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT DISTINCT doc_id, host, text, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, host, text, i, lead(i) OVER (PARTITION BY doc_id, host, text ORDER BY i) AS later
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, host, text, win) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, host, text, sum(least(8, coalesce(later - i, 8))) AS n_repeat_words FROM twice GROUP BY ALL
), l AS (
  SELECT DISTINCT doc_id, host, text, pos, translate(lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), '123456789', '000000000') AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, text, unnest(full_lines) AS line, unnest(range(len(full_lines))) AS pos FROM w)
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM l GROUP BY host
), often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM l GROUP BY host, line) JOIN hosts USING (host)
  WHERE n >= 20 AND (n > 0.01::DOUBLE * host_docs OR n > 1000)
), gone AS (
  SELECT doc_id, host, text, count(*) AS n_removed_lines, sum(words) AS n_removed_words FROM l JOIN often USING (host, line) GROUP BY ALL
), s AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(all_lines)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id AND w.host = rep.host AND w.text = rep.text
    LEFT JOIN gone ON w.doc_id IS NOT DISTINCT FROM gone.doc_id AND w.host = gone.host AND w.text = gone.text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept,
  n_lines, n_removed_lines, n_removed_words
FROM s
"""
