"""Nodes of structured data as structs; a field that is null is left out when they become JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _node(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *[c.alias(name) for name, c in fields.items()])


def list_item(position: Column, name: Column, url: Column) -> Column:
    return _node("ListItem", position=position, name=name, url=url)


def event(title: Column, start: Column, last: Column, place: Column, url: Column) -> Column:
    """A run of a play; callers leave out runs without a first day, as a guessed day is worse than none."""
    return _node("TheaterEvent", name=title, startDate=start, endDate=last, location=_node("Place", name=place), url=url, workPerformed=_node("Play", name=title))


def article(title: Column, excerpt: Column, day: Column, source: Column, url: Column, filed: Column, picture: Column) -> Column:
    """A dispatch; ``filed``: the words it is filed under, which are left out if there are none."""
    words = F.when(F.size(filed) > 0, F.array_join(filed, ", "))
    about = F.struct(F.concat(url, F.lit("#webpage")).alias("@id"))
    return F.struct(
        F.lit("Article").alias("@type"), F.concat(url, F.lit("#article")).alias("@id"), title.alias("headline"), excerpt.alias("description"),
        day.alias("datePublished"), source.alias("isBasedOn"), about.alias("mainEntityOfPage"), words.alias("keywords"), picture.alias("image"),
    )
