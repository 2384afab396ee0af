"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_kmeans import OP12_SQL, op12_ball_kmeans
from .bpe import op2_bpe_tree
from .html_extract import op1_html_main_text
from .importance import op11_importance_resampling
from .langid import op4_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .media import op9_media_columns
from .mixing import OP10_SQL, op10_mixing
from .packing import op13_packing
from .simhash import op6_simhash_components
from .topk import OP5_SQL, op5_topk_maxscore
from .toxicity import op8_toxicity
from .url_filter import OP7_SQL, op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": op1_html_main_text,
    "op2_bpe_tree": op2_bpe_tree,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_topk_maxscore": op5_topk_maxscore,
    "op6_simhash_components": op6_simhash_components,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_media_columns": op9_media_columns,
    "op10_mixing": op10_mixing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_packing": op13_packing,
}

ORACLE: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_topk_maxscore": OP5_SQL, "op7_url_filter": OP7_SQL, "op10_mixing": OP10_SQL, "op12_ball_kmeans": OP12_SQL}
