"""Rows of cells to normalized rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import NormalizeConfig
from rowsieve.functions.latin import register
from rowsieve.functions.normalize import normalize_prepared, prepare


def normalize_row(cells: Column, cfg: NormalizeConfig = NormalizeConfig()) -> Column:
    """Canonical cells of two characters or more, joined; of null or no cells the empty text."""
    # Two steps, so that the many uses of a prepared cell are of a variable.
    made = F.transform(F.transform(cells, prepare), lambda v: normalize_prepared(v, cfg))
    made = F.filter(made, lambda c: F.length(c) >= cfg.min_cell)
    return F.coalesce(F.array_join(made, " | "), F.lit(""))


def normalize_rows(rows: DataFrame, cfg: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """row_id and value of rows (row_id, cells) whose value has min_row characters or more and isn't blank."""
    register(rows.sparkSession)
    out = rows.select("row_id", normalize_row(F.col("cells"), cfg).alias("value"))
    return out.where((F.length("value") >= cfg.min_row) & F.col("value").rlike(r"\S"))
