"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from ..functions.tables import drop_table, write_table

__all__ = ["drop_table", "write_table"]
