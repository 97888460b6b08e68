"""Helpers for Arrow batches."""

from __future__ import annotations

from pyspark.sql import types as T


def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """A copy of ``schema`` with more fields (StructType.add changes its object in place)."""
    return T.StructType([*schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items())])
