"""Pages as trees of blocks: columns that are tables become rows, asides hold blocks, furniture goes.

Rows of columns can stand in columns. They are judged from the innermost out, one round of joins and
groupings for each depth, so a page's boxes never meet those of another page and no round reads what it doesn't change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.operators import blocks as B
from archloom.sources.scratch import Scratch

#: A line of label and value, a sentence that follows another, a bullet.
SHEET = r"^[○◦•\s]*[A-Z][A-Za-z'’ ]{1,28}:\s+\S"
PROSE = r"[a-z0-9)'\"’”][.!?][)'\"’”]?\s+[A-Z(‘“'\"]"
BULLET = "^[○◦•]"
WIDEST = 80

_LINE = "struct<plain:string,bold:boolean,cells:array<string>>"
_LINES = f"array<{_LINE}>"


def _filled(line: Column) -> Column:
    return F.exists(line["cells"], lambda c: c != "")


def _trimmed(lines: Column) -> Column:
    """Without the blank lines at both ends."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(_filled(x), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.slice(lines, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1)).otherwise(F.array().cast(_LINES))


def _most(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test)) * 2 > F.size(lines)


def is_table(left: Column, right: Column, nested: Column) -> Column:
    """Whether two columns of lines, read side by side, are one table.

    As many lines on both sides, three at least; and on the left labels throughout, or else no prose in most lines
    of a side, and either a bold head over each side with nothing bold below, or cells throughout. Not where most
    lines of a side are labels with values, nor where both are all bullets, nor where a side is a table already
    (``nested``) and most lines of a side are labels that stand alone.
    """
    both = F.concat(left, right)
    label = lambda x: x["plain"].endswith(":")
    either = lambda test: _most(left, test) | _most(right, test)
    below = F.concat(F.slice(left, 2, 1 << 30), F.slice(right, 2, 1 << 30))
    headed = F.get(left, 0)["bold"] & F.get(right, 0)["bold"] & ~F.exists(below, lambda x: x["bold"])
    cells = F.forall(both, lambda x: F.char_length(x["plain"]) <= WIDEST)
    table = F.forall(left, label) | (~either(lambda x: x["plain"].rlike(PROSE)) & (headed | cells))
    split = either(lambda x: x["plain"].rlike(SHEET)) | F.forall(both, lambda x: x["plain"].rlike(BULLET)) | (nested & either(label))
    return (F.size(left) >= 3) & (F.size(left) == F.size(right)) & table & ~split


def pair_boxes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, pos, paired, lines) of every row of columns among ``nodes`` (as ``blocks.page_blocks`` gives).

    ``lines`` are the rows of a table, each with its cells, null where the columns aren't one. Blank lines count as
    alignment where both sides are then of one length, else they are left out. A row that holds one that isn't a
    table, or anything but lines, is none itself.
    """
    boxes = nodes.where("type = 'row'").select("page_id", F.col("pos").alias("box"), F.col("level").alias("columns"), "depth")
    inside = nodes.where("side is not null").select("page_id", F.col("parent").alias("box"), "side", "pos", "type", "text", "plain", "bold")
    done = scratch.spark.createDataFrame([], f"page_id long, pos int, paired boolean, lines {_LINES}")
    for depth in range(boxes.agg(F.max("depth")).first()[0] or -1, -1, -1):  # as many as boxes are nested
        now = boxes.where(F.col("depth") == depth)
        held = inside.join(now.select("page_id", "box"), ["page_id", "box"]).join(done, ["page_id", "pos"], "left")
        own = F.array(F.struct("plain", "bold", F.array("text").alias("cells")))
        held = held.withColumn("x", F.when(F.col("type") == "line", own).otherwise(F.coalesce("lines", F.array().cast(_LINES))).cast(_LINES))
        good = F.bool_and((F.col("type") == "line") | F.coalesce("paired", F.lit(False))).alias("good")
        nested = F.bool_or(F.col("type") == "row").alias("nested")
        each = held.groupBy("page_id", "box").agg(good, nested, F.array_sort(F.collect_list(F.struct("pos", "side", "x"))).alias("all"))

        def column(side: int) -> Column:
            return F.flatten(F.transform(F.filter("all", lambda e: e["side"] == side), lambda e: e["x"]))

        each = each.withColumn("l", _trimmed(column(0))).withColumn("r", _trimmed(column(1)))
        aligned = F.size("l") == F.size("r")
        for c in ("l", "r"):
            each = each.withColumn(f"{c}_read", F.when(aligned, F.col(c)).otherwise(F.filter(c, _filled)))
        judged = now.join(each, ["page_id", "box"], "left")
        paired = F.coalesce(F.col("good") & (F.col("columns") == 2) & is_table(F.col("l_read"), F.col("r_read"), F.col("nested")), F.lit(False))
        rows = F.zip_with("l_read", "r_read", lambda a, b: F.struct(a["plain"].alias("plain"), a["bold"].alias("bold"), F.concat(a["cells"], b["cells"]).alias("cells")))
        judged = judged.select("page_id", F.col("box").alias("pos"), paired.alias("paired"), F.when(paired, rows).cast(_LINES).alias("lines"))
        done = scratch.keep(done.unionByName(judged))
    return done


def _pair_line(cells: Column) -> Column:
    """A row of two cells as text: the first one bold."""
    first = F.get(cells, 0)
    named = F.when((first == "") | first.contains("**"), first).otherwise(F.concat(F.lit("**"), first, F.lit("**")))
    return F.array_join(F.filter(F.concat(F.array(named), F.slice(cells, 2, 1 << 30)), lambda c: c != ""), " ")


def page_tree(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, pos, aside, type, level, text, src, ordered, items, rows): ``nodes`` with each row of columns resolved.

    Tables of more than two columns are tables, and take as their head the headings right above them, one for each
    column, unless their first row is all bold; others are paragraphs of labels and values. Columns that are no
    table are the paragraphs and headings that they hold. ``aside`` is the place of the aside that holds a block.
    """
    boxes = pair_boxes(nodes, scratch)
    own = boxes.select("page_id", "pos", "paired", "lines")
    around = boxes.select("page_id", F.col("pos").alias("parent"), F.col("paired").alias("consumed"))
    left = nodes.join(own, ["page_id", "pos"], "left").join(around, ["page_id", "parent"], "left")
    left = left.where("not coalesce(consumed, false) and (type <> 'row' or paired)")
    order = Window.partitionBy("page_id").orderBy("pos")
    plain = (F.col("type") == "line") & F.col("level").isNull() & (F.col("text") != "")
    here = F.struct(plain.alias("p"), "parent", "side")
    opens = ~plain | ~F.coalesce(F.lag(here).over(order).eqNullSafe(here), F.lit(False))
    # a blank line or a block between parts two paragraphs
    left = left.withColumn("part", F.sum(opens.cast("int")).over(order)).where("type <> 'line' or text <> ''")
    rows = F.transform(F.filter("lines", _filled), lambda x: x["cells"])
    wide = F.array_max(F.transform(rows, lambda r: F.size(r))) > 2
    kind = F.when(F.col("type") == "row", F.when(wide, "table").otherwise("p")).when(F.col("type") == "line", F.when(F.col("level").isNotNull(), "h").otherwise("p")).otherwise(F.col("type"))
    said = F.when(F.col("type") == "row", F.when(~wide, F.array_join(F.transform(rows, _pair_line), "\n"))).otherwise(F.col("text"))
    cells = F.when((F.col("type") == "row") & wide, rows).otherwise(F.col("rows"))
    left = left.select("page_id", "part", "pos", "aside", kind.alias("kind"), F.when(F.col("type") != "row", F.col("level")).alias("level"), said.alias("text"), "src", "ordered", "items", cells.alias("rows"))
    same = [F.first(c, True).alias(c) for c in ("aside", "kind", "level", "src", "ordered", "items", "rows")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    found = left.groupBy("page_id", "part").agg(F.min("pos").alias("pos"), text.alias("text"), *same).drop("part")
    found = found.withColumn("text", F.when(F.col("kind").isin("p", "h", "img"), F.col("text"))).withColumnRenamed("kind", "type")
    return _with_heads(scratch.keep(found))


def _with_heads(found: DataFrame) -> DataFrame:
    """Tables with the headings right above them as their first row; those headings go."""
    hold = F.coalesce("aside", F.lit(-1))
    placed = found.select("page_id", "pos", hold.alias("hold"), "type", "text", "rows", F.row_number().over(Window.partitionBy("page_id", hold).orderBy("pos")).alias("n"))
    first = F.filter(F.get("rows", 0), lambda c: c != "")
    bare = placed.where("type = 'table'").where(~((F.size(first) > 0) & F.forall(first, lambda c: c.contains("**"))))
    wide = F.array_max(F.transform("rows", lambda r: F.size(r)))
    asked = bare.select("page_id", "hold", F.col("pos").alias("table"), wide.alias("wide"), F.explode(F.sequence(F.col("n") - wide, F.col("n") - 1)).alias("n"))
    met = asked.join(placed.where("type = 'h'").select("page_id", "hold", "n", "pos", "text"), ["page_id", "hold", "n"])
    heads = met.groupBy("page_id", "table", "wide").agg(F.array_sort(F.collect_list(F.struct("n", "pos", "text"))).alias("heads")).where("size(heads) = wide")
    taken = heads.select("page_id", F.explode("heads.pos").alias("pos"))
    head = heads.select("page_id", F.col("table").alias("pos"), F.transform("heads", lambda h: h["text"]).alias("head"))
    out = found.join(taken, ["page_id", "pos"], "left_anti").join(head, ["page_id", "pos"], "left")
    return out.withColumn("rows", F.when(F.col("head").isNotNull(), F.concat(F.array("head"), F.col("rows"))).otherwise(F.col("rows"))).drop("head")


def is_label(text: Column, kind: Column) -> Column:
    """A heading, or a paragraph whose lines are all one bold run."""
    return (kind == "h") | ((kind == "p") & F.forall(F.split(text, "\n"), lambda x: x.rlike(r"^\*\*[^*]+\*\*$")))


def without_furniture(tree: DataFrame, notice: str, scratch: Scratch) -> DataFrame:
    """``tree`` (as ``page_tree`` gives, with ``title``) without notices, navigation, labels of nothing and empty asides.

    Notices go line by line. Navigation goes with the heading kept last before it, in an aside as on the page; an
    aside that then holds labels only goes too. A heading that repeats the title is left out while nothing is kept before it.
    """
    text = F.when(F.col("type") == "p", B.drop_lines(F.col("text"), notice)).otherwise(F.col("text"))
    rows = tree.withColumn("text", text).where("type <> 'p' or text <> ''")
    rows = scratch.keep(rows.withColumn("nav", (F.col("type") == "p") & B.is_navigation(F.col("text"))).withColumn("skip", (F.col("type") == "h") & (F.col("text") == F.col("title"))))

    def kept(part: DataFrame) -> DataFrame:
        """(page_id, aside, pos) of what stays in each container."""
        keyed = part.withColumn("page_id", F.struct("page_id", F.coalesce("aside", F.lit(-1)).alias("aside")))
        stays = keyed.join(B.drop_navigation(keyed.select("page_id", "pos", "type", "nav", "skip")), ["page_id", "pos"])
        ranked = stays.select("page_id", "pos", F.when(F.col("type") == "h", F.col("level")).alias("rank"))
        return B.drop_empty_labels(ranked).select("page_id.page_id", "pos")

    inner = rows.where("aside is not null").join(kept(rows.where("aside is not null")), ["page_id", "pos"])
    full = inner.where(~is_label(F.col("text"), F.col("type"))).select("page_id", F.col("aside").alias("pos")).distinct()
    outer = rows.where("aside is null")
    outer = outer.where("type <> 'aside'").unionByName(outer.where("type = 'aside'").join(full, ["page_id", "pos"], "left_semi"))
    outer = scratch.keep(outer.join(kept(outer), ["page_id", "pos"]))
    inner = inner.join(outer.where("type = 'aside'").select("page_id", F.col("pos").alias("aside")), ["page_id", "aside"], "left_semi")
    return outer.unionByName(inner).drop("nav", "skip", "title")
