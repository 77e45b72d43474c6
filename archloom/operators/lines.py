"""Lines of curated pages: listings under carried headings, chronologies, and cast tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.functions import prose as P
from archloom.functions import text as X

_BULLET = r"^[\s○◦•*]+"
_BOLD = r"(?s)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>"


def with_dates(rows: DataFrame, column: str, name: str = "d") -> DataFrame:
    """``rows`` with the date (label, year) that ``column`` states, or null. Each different text is read once."""
    texts = rows.select(column).where(F.col(column).rlike(X.HAS_YEAR)).distinct()
    return rows.join(texts.select(column, X.date_of(F.col(column)).alias(name)), column, "left")


def listing_rows(paragraphs: DataFrame, *, most: int = 40) -> DataFrame:
    """(page_id, pos, kind, heading, title, venue, dates, detail, href) of curated pages' paragraphs (page_id, pos, markup).

    A paragraph that begins with ``◦`` is an item: its title is the bold run, what follows its break is
    detail. One that is all bold and shorter than ``most`` heads the items below it, a longer one is
    left out; all others are intro and have no heading. Empty and null paragraphs are left out.
    """
    raw = X.visible(F.regexp_replace("markup", r"(?i)<br\s*/?>", "\n"))
    bold = X.visible(F.regexp_extract("markup", _BOLD, 1))
    lead = F.regexp_extract("markup", r"(?is)^(.*?)(?:<br\s*/?>|$)", 1)
    rows = paragraphs.select("page_id", "pos", raw.alias("raw"), bold.alias("bold"), X.visible(lead).alias("lead"), X.visible(F.regexp_extract("markup", r"(?is)<br\s*/?>(.*)$", 1)).alias("detail"), F.regexp_extract("markup", r'(?i)<a\b[^>]*\bhref="([^"]*)"', 1).alias("href"))
    rows = rows.where("raw <> ''")
    all_bold = (F.col("bold") != "") & (F.col("bold") == F.col("raw"))
    kind = F.when(F.col("raw").startswith("◦"), "item").when(all_bold & (F.char_length("raw") < most), "heading").when(all_bold, "dropped").otherwise("intro")
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("under", F.last(F.when(F.col("kind") == "heading", F.col("raw")), True).over(above)).where("kind in ('item', 'intro')")
    item = F.col("kind") == "item"
    rows = rows.withColumn("l", F.when(item, X.listing_line(F.col("lead"), F.col("bold"))))
    only = lambda c: F.when(item, F.coalesce(c, F.lit("")))
    return rows.select("page_id", "pos", "kind", F.when(item, F.col("under")).alias("heading"), F.col("l.title").alias("title"), F.col("l.where").alias("venue"), F.col("l.when").alias("dates"), only(F.col("detail")).alias("detail"), F.nullif("href", F.lit("")).alias("href"))


def listing_targets(items: DataFrame, pages: DataFrame, posters: DataFrame) -> DataFrame:
    """``items`` (title) with the ``route`` of the page of that title, whatever its case, and that page's ``poster``.

    ``pages``: title, route (the least route where titles repeat). ``posters``: route, poster.
    """
    by_title = pages.groupBy(F.lower(F.trim("title")).alias("_key")).agg(F.min("route").alias("route"))
    found = items.withColumn("_key", F.lower(F.trim("title"))).join(by_title, "_key", "left").drop("_key")
    return found.join(posters.groupBy("route").agg(F.min("poster").alias("poster")), "route", "left").select(*items.columns, "route", "poster")


def timeline_rows(paragraphs: DataFrame, *, least: int = 6) -> DataFrame:
    """(page_id, run, entry, kind, label, year, events) of the chronologies in pages' paragraphs (page_id, pos, text of markdown lines).

    Only pages with ``least`` dated lines or more. Paragraphs one after the other that hold a date are one run, however
    they are cut. A bold date opens an entry; lines below are its events, a line after a leader (``..``)
    goes on with the event above; an all-bold line that is no date is a label and closes the entry;
    lines with no entry open are prose. ``pos`` counts a page's paragraphs without gaps.
    """
    lines = paragraphs.select("page_id", "pos", F.posexplode(P.lines(F.col("text"))).alias("i", "line"))
    head = F.regexp_extract("line", r"^\*\*([^*]+)\*\*", 1)
    rest = F.trim(F.regexp_replace("line", r"^\*\*[^*]+\*\*", ""))
    lines = lines.select("page_id", "pos", "i", "line", head.alias("head"), rest.alias("rest"))
    lines = with_dates(lines, "head")
    dated = F.col("d").isNotNull()
    only_mark = F.col("head").rlike(r"^[\s○◦•]+$")
    marked = F.col("head").rlike(r"^\s*[○◦•]")
    kind = F.when(dated, "date").when((F.col("head") != "") & ~marked & (F.col("rest") == ""), "label").when(F.col("line").rlike(r"^\*?[.…]{2,}"), "wrap").otherwise("event")
    unmarked = F.concat(F.lit("**"), F.regexp_replace("head", _BULLET, ""), F.lit("**"), F.regexp_replace("line", r"^\*\*[^*]+\*\*", ""))
    body = (
        F.when(dated, F.col("rest"))
        .when(F.col("kind") == "wrap", F.regexp_replace("line", r"^\*?[.…]{2,}\*?", ""))
        .when(F.col("kind") == "label", F.col("head"))
        .when(only_mark, F.col("rest"))
        .when(marked, unmarked)
        .otherwise(F.regexp_replace("line", r"^[\s○◦•]+", ""))
    )
    lines = lines.withColumn("kind", kind).select("page_id", "pos", "i", "kind", F.trim(body).alias("body"), F.col("d.label").alias("label"), F.col("d.year").alias("year"))
    # one order serves all windows, so a task sorts its lines once; what is counted inside a group is a page's count less that before the group
    order = Window.partitionBy("page_id").orderBy("pos", "i")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    page, paragraph = order.rowsBetween(*whole), Window.partitionBy("page_id", "pos").orderBy("i").rowsBetween(*whole)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin("date", "label")

    def counted(rows: DataFrame, name: str, start: str, flag: Column) -> DataFrame:
        """``rows`` with ``name``, how many of ``flag`` there are from the group's first line (``start``) to this one."""
        rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int")).withColumn("_all", F.sum("_flag").over(so_far))
        rows = rows.withColumn("_before", F.max(F.when(F.col(start), F.col("_all") - F.col("_flag"))).over(so_far))
        return rows.withColumn(name, F.col("_all") - F.col("_before")).drop("_flag", "_all", "_before")

    lines = lines.withColumn("n", F.count_if(F.col("kind") == "date").over(page)).withColumn("in_run", F.max((F.col("kind") == "date").cast("int")).over(paragraph))
    lines = lines.where((F.col("n") >= least) & (F.col("in_run") == 1)).drop("n", "in_run")
    first = F.coalesce(F.lag("pos").over(order) < F.col("pos") - 1, F.lit(True))
    lines = lines.withColumn("first", first).withColumn("below", F.coalesce(F.lag("kind").over(order) == "label", F.lit(False)))
    lines = lines.withColumn("run", F.sum(F.col("first").cast("int")).over(so_far))
    lines = counted(lines, "entry", "first", opens)
    # an entry's first line says what it is; what stands before any, or below a label, is prose
    opened = F.last(F.when(F.col("first") | opens, F.col("kind")), True).over(so_far)
    lines = lines.withColumn("opened", opened).withColumn("shown", F.when(F.col("opened") == "date", "date").when(F.col("kind") == "label", "label").otherwise("prose"))
    lines = lines.withColumn("new", F.col("first") | opens | F.col("below"))
    is_event = (F.col("kind").isin("event", "wrap") | ((F.col("kind") == "date") & (F.col("body") != ""))) & (F.col("shown") == "date")
    lines = counted(lines.withColumn("is_event", is_event), "events", "new", F.col("is_event"))
    starts = F.col("is_event") & ((F.col("kind") != "wrap") | (F.col("events") == 1))
    lines = counted(lines, "event", "new", starts | (F.col("shown") != "date"))
    keys = ["page_id", "run", "entry", "shown"]
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "body"))), lambda x: x["body"]), " ")
    events = lines.groupBy(*keys, "event").agg(part.alias("said"), F.max("label").alias("label"), F.max("year").alias("year"))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("event") > 0, F.struct("event", "said")))), lambda x: F.trim(x["said"]))
    out = events.groupBy(*keys).agg(F.max("label").alias("label"), F.max("year").alias("year"), said.alias("events"))
    return out.withColumnRenamed("shown", "kind")


def cast_tables(paragraphs: DataFrame) -> DataFrame:
    """(page_id, pos, caption, columns, credits, rows) of the paragraphs that are cast tables (page_id, pos, text).

    The header is the first line of just two bold words or runs; each line below it is a row, a bold lead and the rest, each
    above it a credit of the same shape; with any other line, or no row, it is no table. The caption
    is ``Cast`` where the second column is headed ``actor`` or ``actors``.
    """
    x = P.lines(F.col("text"))
    two = r"^\*\*([^*]+)\*\*\s+\*\*([^*]+)\*\*$"
    rows = paragraphs.select("page_id", "pos", x.alias("x")).withColumn("at", F.array_position(F.transform("x", lambda v: v.rlike(two)), True).cast("int"))
    rows = rows.where((F.col("at") > 0) & (F.col("at") < F.size("x")))
    shape = r"^\*\*([^*]+)\*\*\s*(\S.*)$"
    above, below = F.slice("x", F.lit(1), F.col("at") - 1), F.slice("x", F.col("at") + 1, F.size("x") - F.col("at"))
    good = F.forall(above, lambda v: v.rlike(shape)) & F.forall(below, lambda v: v.rlike(shape))
    cells = lambda a: F.transform(a, lambda v: F.struct(F.trim(F.regexp_extract(v, shape, 1)).alias("label"), F.trim(F.regexp_extract(v, shape, 2)).alias("value")))
    header = F.element_at("x", F.col("at"))
    column = lambda i: F.trim(F.regexp_extract(header, two, i))
    return rows.where(good).select("page_id", "pos", F.when(column(2).rlike(r"(?i)^actors?\b"), "Cast").alias("caption"), F.array(column(1), column(2)).alias("columns"), cells(above).alias("credits"), cells(below).alias("rows"))
