"""What names a row besides its doc_id, which need not be unique."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def text_digest(text: str = "text") -> Column:
    """md5 of the text (null: of nothing), which tells apart rows that share a doc_id."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
