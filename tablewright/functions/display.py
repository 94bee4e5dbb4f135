"""How a reading is shown: names, the wide column, columns of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of columns that hold words, that hold figures, and that hold descriptions.
WORDED = r"(?i)part|upc|sku|desc|name|item"
FIGURES = r"(?i)\b(?:qty|quantity|price|prc|amount|amt|ext|extended|total|pack)\b"
DESCRIBING = r"(?i)description|product|item name"
# What a page without a printed title is called, by kind.
TITLES = {"inventory": "Inventory Summary", "settlements": "Pack Settlements", "invoice": "Invoice Breakdown", "table": "Invoice"}


def is_figure_title(title: Column) -> Column:
    return ~title.rlike(WORDED) & title.rlike(FIGURES)


def wide_column(kind: Column, headers: Column) -> Column:
    """The place (from 0) of the column that is set flush left and may grow."""
    places = F.filter(F.transform(headers, lambda h, i: F.when(h.rlike(DESCRIBING), i)), lambda i: i.isNotNull())
    return F.when(kind == "invoice", 0).when(kind != "table", 1).otherwise(F.coalesce(F.array_min(places), F.lit(0)))


def figure_columns(kind: Column, headers: Column) -> Column:
    """For each column, whether it is shown as figures."""
    wide = wide_column(kind, headers)
    return F.transform(headers, lambda h, i: F.when(kind == "table", is_figure_title(h)).otherwise(i != wide))


def shown_title(title: Column, kind: Column) -> Column:
    named = F.element_at(F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair)), kind)
    return F.coalesce(F.nullif(title, F.lit("")), named)


def base_name(file: Column, fallback: str = "document") -> Column:
    """A file's name without its last extension."""
    return F.coalesce(F.nullif(F.regexp_replace(file, r"\.[^.]+$", ""), F.lit("")), F.lit(fallback))
