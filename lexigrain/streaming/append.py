"""Growing a saved index. The engine indexes bounded tables only; appending is its one way to take in later documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, read_manifest, with_ids


def append(spark: SparkSession, path: str, texts: DataFrame, order: str = "path", text_col: str = "text") -> int:
    """Add documents to a saved index; they are numbered in the given order after the largest id ever given there. Returns the
    first new id. Only the new documents are read and written; they count once the next manifest names them, all or none.
    ``text_col`` fills the body where the table has no column of that zone's name; columns that it lacks are null."""
    info = read_manifest(spark, path)
    body = info["zones"].get("body")
    held = texts.withColumn(body, F.col(text_col)) if body and body not in texts.columns and text_col in texts.columns else texts
    numbered = with_ids(held.drop("doc_id").withColumn("_order", F.col(order)), ["_order"], info["next_id"])
    kinds = _columns(info)
    ready = numbered.select(*[(F.col(c) if c in numbered.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
    Index.of(ready, zones=info["zones"]).add_to(path, info)
    return info["next_id"]


def _columns(info: dict) -> list:
    import json

    from pyspark.sql.types import StructType

    return [(f.name, f.dataType) for f in StructType.fromJson(json.loads(info["columns"]))]
