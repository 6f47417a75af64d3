"""Append-only logs: events, model calls and chats, without content unless it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.observability import without_content


def append(rows: DataFrame, path: str, *content: str, keep_content: bool = False) -> None:
    """rows as JSON lines; columns content are hashed and measured instead of written, unless kept."""
    (rows if keep_content else without_content(rows, *content)).withColumn("ts", F.current_timestamp()).write.mode("append").json(path)
