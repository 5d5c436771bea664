"""The caller's columns beside an operator's own: they travel in one struct, so that no name of theirs can clash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "rest"
_OWN = ("doc_id", "text")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and, if there are more columns, the struct ``rest`` of all others."""
    others = [_column(c) for c in docs.columns if c not in _OWN]
    return docs.select(*_OWN, *([F.struct(*others).alias(REST)] if others else []))


def restored(rows: DataFrame, docs: DataFrame, changed: Mapping[str, Column] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, from rows that hold what ``carried`` gave, then the columns ``more`` of the rows.

    Columns in ``changed`` get that value instead; a column of ``docs`` named like one of ``more`` is left out.
    """
    changed = changed or {}

    def one(name: str) -> Column:
        kept = F.col(name) if name in _OWN else F.col(REST).getField(name)
        return changed.get(name, kept).alias(name)

    return rows.select(*[one(c) for c in docs.columns if c not in more], *more)
