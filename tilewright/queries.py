"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from .plans import image_queries, join_queries, model_queries, more_queries, quality_queries, source_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
