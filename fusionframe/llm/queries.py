"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .asof_join import OP12_SQL, op12_asof_join
from .chat_format import OP10_SQL, op10_chat_format
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op8_decontamination
from .html_extract import OP1_SQL, op1_html_extract
from .license_scan import OP11_SQL, op11_license_scan
from .mixing import op2_mix_sources
from .media import op6_media_columns
from .ngram_join import OP9_SQL, op9_ngram_join
from .pii import op7_pii
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_mix_sources": op2_mix_sources,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_token_counts": op5_token_counts,
        "op6_media_columns": op6_media_columns,
        "op7_pii": op7_pii,
        "op8_decontamination": op8_decontamination,
        "op9_ngram_join": op9_ngram_join,
        "op10_chat_format": op10_chat_format,
        "op11_license_scan": op11_license_scan,
        "op12_asof_join": op12_asof_join,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_html_extract": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op9_ngram_join": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_license_scan": OP11_SQL, "op12_asof_join": OP12_SQL, "op13_collocations": OP13_SQL}
