"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat
from .decontaminate import op9_decontaminate
from .fingerprints import op2_fingerprint
from .langid import op4_language
from .mixing import op3_mixing
from .oracles import oracle_sql
from .pii import op1_pii
from .repeats import op6_repeats
from .simhash import op5_simhash
from .toxicity import op10_toxicity
from .urls import op7_urls

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_fingerprint": op2_fingerprint,
        "op3_mixing": op3_mixing,
        "op4_language": op4_language,
        "op5_simhash": op5_simhash,
        "op6_repeats": op6_repeats,
        "op7_urls": op7_urls,
        "op8_chat": op8_chat,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
    }
