"""Names and schemas of tables, next to the library's own shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from spanloom.store import last_table, materialise, release, remove, scratch_path, shared_dir, tables_of_run

__all__ = ["free_name", "last_table", "materialise", "release", "remove", "scratch_path", "shared_dir", "tables_of_run", "wider"]


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, or it with underscores behind where a column has that name already."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def wider(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the fields of ``ddl`` behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
