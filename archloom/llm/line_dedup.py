"""Line dedup: runs of lines that occur again are deleted from all but their first place.

The corpus is one sequence of line ids. Prefix doubling sorts its suffixes: after round k, suffixes are
ranked by their first 2**k lines, and those of one rank form an interval of the suffix array whose
longest common prefix is 2**k lines or more. A suffix that stands alone in its interval leaves, so
each round works on what still repeats. Going back from the largest power to the smallest splits the
intervals and gives each suffix the exact length that it shares with an earlier place. Only joins,
aggregations and sorts on (document, place) or on ranks are used: no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.llm.columns import SPACES, has_word, let, lines, word_count
from archloom.sources.scratch import Scratch

PLACE = ["d", "tk", "pos"]
NO_ID = -(1 << 63)


def _ranked(keys: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """``keys``, which differ, with order-preserving numbers as ``r``: the place in a sorted table, kept once."""
    return scratch.keep(keys.orderBy(*by).withColumn("r", F.monotonically_increasing_id()))


def suffix_ranks(seq: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The repeated suffixes by round: element k has (d, tk, pos, r) for prefixes of 2**k lines that occur twice or more.

    ``seq``: d, tk, pos, c (line id). The order of r within a round is that of the suffix array.
    """
    again = seq.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    ranks = [scratch.keep(seq.join(_ranked(again, ["c"], scratch), "c").select(*PLACE, "r"))]
    while not ranks[-1].isEmpty():
        now, step = ranks[-1], 1 << (len(ranks) - 1)
        second = now.select("d", "tk", (F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
        both = scratch.keep(now.withColumnRenamed("r", "r1").join(second, PLACE))
        pairs = both.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2")
        ranks.append(scratch.keep(both.join(_ranked(pairs, ["r1", "r2"], scratch), ["r1", "r2"]).select(*PLACE, "r")))
        scratch.drop(both)
    return ranks[:-1]


def earlier_lengths(seq: DataFrame, ranks: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(d, tk, pos, words, len): the number of lines from a place on that also stand at an earlier place.

    Each suffix starts at the root. For each power, from the largest, the suffixes of a node that go
    on with the same lines split off together. The first of them stays behind too, to stand for all of
    them among shorter prefixes, and goes with them only as the earlier place (``claim`` false).
    """
    base = seq.join(ranks[0].select(*PLACE), PLACE) if ranks else seq.limit(0)
    state = scratch.keep(base.select(*PLACE, "words", F.lit(0).cast("long").alias("node"), F.lit(0).alias("len"), F.lit(True).alias("claim")))
    for k in range(len(ranks) - 1, -1, -1):
        ahead = ranks[k].select("d", "tk", F.col("pos").alias("at"), "r")
        ext = scratch.keep(state.withColumn("at", F.col("pos") + F.col("len")).join(ahead, ["d", "tk", "at"], "left").drop("at"))
        split = ext.where("r is not null").groupBy("node", "r").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
        split = split.select(F.col("node").alias("s_node"), F.col("r").alias("s_r"), "first")
        met = ext.where("r is not null").join(split, (F.col("node") == F.col("s_node")) & (F.col("r") == F.col("s_r")), "left")
        is_first = F.struct(*PLACE) == F.col("first")
        deeper = F.struct(F.xxhash64(F.lit(k), "node", "r").alias("node"), (F.col("len") + (1 << k)).alias("len"), (F.col("claim") & ~is_first).alias("claim"))
        stays = F.struct("node", "len", "claim")
        to = F.when(F.col("first").isNull(), F.array(stays)).when(is_first, F.array(stays, deeper)).otherwise(F.array(deeper))
        moved = met.select(*PLACE, "words", F.explode(to).alias("x")).select(*PLACE, "words", "x.node", "x.len", "x.claim")
        after = scratch.keep(ext.where("r is null").select(*moved.columns).unionByName(moved))
        scratch.drop(state, ext)
        state = after
    return state.where("claim and len > 0").select(*PLACE, "words", "len")


def repeated_runs(found: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(d, tk, runs array<struct<pos, end>>): the maximal runs of ``min_words`` words or more that stand earlier too."""
    by_doc = Window.partitionBy("d", "tk").orderBy("pos")
    ends = found.withColumn("end", F.col("pos") + F.col("len"))
    ends = ends.withColumn("cum", F.sum("words").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    ends = scratch.keep(ends.withColumn("before", F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))))
    # every line of such a run starts one itself, so its last line is in the table
    last = ends.select("d", "tk", (F.col("pos") + 1).alias("end"), F.col("cum").alias("total"))
    runs = ends.where("before is null or end > before").join(last, ["d", "tk", "end"])
    runs = runs.where(F.col("total") - F.col("cum") + F.col("words") >= min_words)
    return runs.groupBy("d", "tk").agg(F.array_sort(F.collect_list(F.struct("pos", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: (id, n_lines, n_removed_lines, n_removed_words, removed, clean_text).

    Lines are split at line feeds and compared without white space at their ends; lines without a word
    neither count nor break a run, and stay. A run goes where its lines, ``min_words`` words at least,
    also stand at an earlier place (smaller id, then text hash, then line); overlaps are allowed.
    removed: the line numbers, from 0. Null texts give null clean_text and no lines. Rows without an
    id come first in the order. Rows with equal id and text count as one and get equal results.
    ``carry`` adds those columns of ``docs`` as the struct ``row``; others are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text_col).cast("string").alias("_text"), *([F.struct(*carry).alias("row")] if carry else []))
    read = read.withColumn("tk", F.coalesce(F.xxhash64("_text"), F.lit(0)))
    full = F.transform(F.filter(lines(F.col("_text")), has_word), lambda x: F.struct(F.xxhash64(F.trim(x, F.lit(SPACES))).alias("c"), word_count(x).alias("words")))
    rows = read.select("d", "tk", F.posexplode(full).alias("pos", "x")).select("d", "tk", "pos", "x.c", "x.words")
    again = rows.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    seq = scratch.keep(rows.join(again, "c").select(*PLACE, "c", "words").distinct())
    ranks = suffix_ranks(seq, scratch)
    found = earlier_lengths(seq, ranks, scratch)
    runs = scratch.keep(repeated_runs(found, scratch, min_words)).hint("shuffle_hash")
    joined = read.join(runs, ["d", "tk"], "left")

    def cut(all_lines):
        places = F.filter(F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: has_word(F.get(all_lines, i)))
        gone = let(places, lambda p: F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice(p, r["pos"] + 1, r["end"] - r["pos"]))))))
        return let(
            gone,
            lambda g: F.struct(
                g.alias("removed"),
                F.aggregate(F.transform(g, lambda i: word_count(F.get(all_lines, i))), F.lit(0), lambda a, b: a + b).cast("long").alias("words"),
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), g), lambda i: F.get(all_lines, i)), "\n").alias("text"),
            ),
        )

    made = F.when(F.col("runs").isNotNull(), let(lines(F.col("_text")), cut))
    out = joined.select("_id", "_text", made.alias("x"), *(["row"] if carry else []))
    nothing = F.array().cast("array<int>")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines(F.col("_text")))).cast("long").alias("n_lines"),
        F.when(F.col("x").isNull(), 0).otherwise(F.size("x.removed")).cast("long").alias("n_removed_lines"),
        F.coalesce("x.words", F.lit(0)).cast("long").alias("n_removed_words"),
        F.coalesce("x.removed", nothing).alias("removed"),
        F.when(F.col("x").isNotNull(), F.col("x.text")).otherwise(F.col("_text")).alias("clean_text"),
        *(["row"] if carry else []),
    )


#: The same rows from DuckDB. A run of 50 words or more that stands earlier is the union of its least runs of
#: 50 words from each first line on, and back from each last line; those are compared as text.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents)
), f AS (
  SELECT rid, doc_id, text, i, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS c, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL)
), g AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos, sum(w) OVER (PARTITION BY rid ORDER BY i) AS cum FROM f WHERE w > 0
), cs AS (
  SELECT rid, list(c ORDER BY pos) AS c, list(i ORDER BY pos) AS places FROM g GROUP BY rid
), win AS (
  SELECT DISTINCT a.rid, a.doc_id, a.text, a.pos AS p, b.pos AS q FROM g a JOIN g b ON a.rid = b.rid AND a.pos <= b.pos
  WHERE b.cum - a.cum + a.w >= 50 AND (b.cum - b.w - a.cum + a.w < 50 OR b.cum - a.cum < 50)
), keyed AS (
  SELECT win.*, array_to_string(list_slice(c, p, q), chr(10)) AS run, min({'a': coalesce(win.doc_id, -9223372036854775808), 'b': win.text, 'c': p}) OVER (PARTITION BY array_to_string(list_slice(c, p, q), chr(10))) AS first
  FROM win JOIN cs USING (rid)
), gone AS (
  SELECT DISTINCT rid, unnest(list_slice(places, p, q)) AS i FROM keyed JOIN cs USING (rid) WHERE first <> {'a': coalesce(doc_id, -9223372036854775808), 'b': text, 'c': p}
), cut AS (
  SELECT rid, list((i - 1)::INTEGER ORDER BY i) AS removed, sum(w)::BIGINT AS words FROM gone JOIN f USING (rid, i) GROUP BY rid
)
SELECT x.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed_lines, coalesce(words, 0)::BIGINT AS n_removed_words,
  coalesce(removed, []::INTEGER[]) AS removed,
  CASE WHEN removed IS NULL THEN x.text ELSE array_to_string(list_filter(ls, lambda v, i: NOT list_contains(removed, (i - 1)::INTEGER)), chr(10)) END AS clean_text
FROM documents x JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.text IS NOT DISTINCT FROM d.text LEFT JOIN cut USING (rid)
"""
