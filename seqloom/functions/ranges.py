"""Range strings ``name(strand):start-end`` as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = r"^(.*)\((.)\):(\d+)-(\d+)$"


def parse_range(text: Column) -> Column:
    """Struct of name, strand, start and end; null where the text is no range."""
    part = lambda i: F.regexp_extract(text, _RANGE, i)
    return F.when(
        text.rlike(_RANGE), F.struct(part(1).alias("name"), part(2).alias("strand"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"))
    )


_REGION = r"^(.+?)(?:\(([+-])\))?(?::(\d+)(?:-(\d+))?)?$"


def parse_region(text: Column) -> Column:
    """Struct of name, strand, start and end of what a user asks for: strand ``+`` unless given, start and end null for a whole record, one place without ``-``."""
    part = lambda i: F.regexp_extract(text, _REGION, i)
    number = lambda i: F.when(part(i) != "", part(i).try_cast("long"))
    start = number(3)
    return F.when(text.rlike(_REGION), F.struct(part(1).alias("name"), F.when(part(2) == "", "+").otherwise(part(2)).alias("strand"), start.alias("start"), F.coalesce(number(4), start).alias("end")))


def format_range(name: Column, strand: Column, start: Column, end: Column) -> Column:
    return F.concat(name, F.lit("("), strand, F.lit("):"), start.cast("string"), F.lit("-"), end.cast("string"))


def flip_strand(strand: Column, flip: Column) -> Column:
    return F.when(flip, F.when(strand == "-", "+").otherwise("-")).otherwise(strand)
