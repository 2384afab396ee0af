"""Every query of the library with its DuckDB twin."""

from . import bpe_queries, catalog_queries, ct_queries, layout_queries, ordered_queries, scan_queries, stat_queries, store_queries, stream_queries, study_queries, text_queries, value_queries, voxel_queries, vq_queries  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
