"""Figures in Markdown tables and the pins that tie them to their sources.

A pin names a literal of a document. The numeric cells of a document's tables
and the places where its pins' literals stand are byte ranges; a cell that no
pinned range covers and that is not exempt is a figure nothing answers for.
Ranges meet by (document, block of BLOCK bytes), so a long document does not pit
all its cells against all its pins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
# Fixed value: what counts as a figure in a cell.
NUMERIC = r"^\*{0,2}-?\d+(?:[.,]\d+)*\*{0,2}$"


def lines(documents: DataFrame, key: str = "document", text: str = "text") -> DataFrame:
    """key, line_number (from 1), line, start: each line and the byte at which it starts."""
    each = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line"))
    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    return each.select(key, (F.col("_i") + 1).alias("line_number"), "line", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


def numeric_cells(documents: DataFrame, key: str = "document", text: str = "text") -> DataFrame:
    """key, line_number, cell (without asterisks), start, length in bytes: the cells of tables that are numbers."""
    row = lines(documents, key, text).where(F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^[|\-: ]*$"))
    cells = row.select(key, "line_number", "line", "start", F.posexplode(F.split("line", r"\|")).alias("_i", "_cell"), F.size(F.split("line", r"\|")).alias("_n"))
    before = F.sum(F.octet_length("_cell") + 1).over(Window.partitionBy(key, "line_number").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    placed = cells.withColumn("_at", F.col("start") + F.coalesce(before, F.lit(0)))
    lead = lambda c, of: F.octet_length(c) - F.octet_length(F.regexp_replace(c, of, ""))
    trimmed = placed.withColumn("_bold", F.trim("_cell")).where(F.col("_bold").rlike(NUMERIC))
    bare = F.regexp_replace("_bold", r"^\*+|\*+$", "")
    start = F.col("_at") + lead("_cell", r"^\s+") + lead("_bold", r"^\*+")
    return trimmed.select(key, "line_number", bare.alias("cell"), start.cast("long").alias("start"), F.octet_length(bare).alias("length"))


def occurrences(documents: DataFrame, pins: DataFrame, key: str = "document", text: str = "text", literal: str = "literal") -> DataFrame:
    """key, literal, start, length in bytes: every place of each pin's literal in its document, overlaps left out."""
    both = documents.join(pins.select(key, literal).where(F.octet_length(literal) > 0).distinct(), key)
    parts = both.select(key, literal, F.posexplode(F.expr(f"split({text}, concat('\\\\Q', {literal}, '\\\\E'), -1)")).alias("_i", "_part"))
    w = Window.partitionBy(key, literal).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    spot = (F.sum(F.octet_length("_part")).over(w) + F.col("_i") * F.octet_length(literal)).cast("long")
    last = F.max("_i").over(Window.partitionBy(key, literal))
    return parts.select(key, literal, spot.alias("start"), F.octet_length(literal).alias("length"), (F.col("_i") < last).alias("_there")).where("_there").drop("_there")


def uncovered(cells: DataFrame, spans: DataFrame, key: str = "document") -> DataFrame:
    """The cells that lie in no span of their document."""
    block = lambda x: F.floor(x / BLOCK)
    own = cells.withColumn("_block", block(F.col("start")))
    wide = spans.select(key, F.col("start").alias("_s"), (F.col("start") + F.col("length")).alias("_e")).withColumn("_block", F.explode(F.sequence(block(F.col("_s")), block(F.greatest(F.col("_e") - 1, F.col("_s"))))))
    inside = (F.col("_s") <= F.col("start")) & (F.col("start") + F.col("length") <= F.col("_e"))
    on = (own[key] == wide[key]) & (own["_block"] == wide["_block"]) & inside
    return own.join(wide, on, "left_anti").drop("_block")


def unpinned_cells(documents: DataFrame, pins: DataFrame, exempt: tuple[str, ...] = (), key: str = "document", text: str = "text", literal: str = "literal") -> DataFrame:
    """Numeric cells of the documents that have pins which no pin of theirs stands for: neither exempt nor covered by a place of a pinned literal."""
    checked = documents.join(pins.select(key).distinct(), key, "left_semi")
    cells = numeric_cells(checked, key, text)
    cells = cells.where(~F.col("cell").isin(*exempt)) if exempt else cells
    return uncovered(cells, occurrences(checked, pins, key, text, literal), key)


def missing_literals(documents: DataFrame, pins: DataFrame, key: str = "document", text: str = "text", literal: str = "literal") -> DataFrame:
    """The pins whose literal is nowhere in their document, or whose document is not there."""
    there: Column = F.contains(text, F.col(literal))
    return pins.join(documents.select(key, text), key, "left").where(~F.coalesce(there, F.lit(False))).drop(text)
