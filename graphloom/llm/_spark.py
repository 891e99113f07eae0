"""Session helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_folder, drop_table, shared_checkpoint, shared_table

__all__ = ["checkpoint_dir", "drop_folder", "drop_rows", "drop_table", "keep_rows", "shared_checkpoint", "shared_table"]

#: Names no input is expected to have.
_ID, _TH = "_graphloom_id", "_graphloom_th"


def _keyed(rows: DataFrame, id_col: str, hashed) -> DataFrame:
    return rows.withColumns({_ID: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), _TH: hashed})


def _matched(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    own = _keyed(docs, id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return own.join(_keyed(chosen.select(id_col, "th"), id_col, F.col("th")).select(_ID, _TH), [_ID, _TH], how)


def keep_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each id and text among ``chosen`` (``id_col``, th)."""
    return _matched(docs, chosen, id_col, text_col, "left_semi").dropDuplicates([_ID, _TH]).select(*docs.columns)


def drop_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text are among ``chosen``."""
    return _matched(docs, chosen, id_col, text_col, "left_anti").select(*docs.columns)
