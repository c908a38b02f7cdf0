"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .html import op1_html
from .langid import op9_langid
from .minhash import op7_minhash
from .ngram import op6_stupid_backoff
from .packing import op4_best_fit
from .suffix import op3_suffix
from .toxicity import op10_toxicity
from .topk import OP8_SQL, op8_topk
from .winnow import op5_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_bpe": op2_bpe, "op3_suffix": op3_suffix, "op4_best_fit": op4_best_fit, "op5_winnowing": op5_winnowing, "op6_stupid_backoff": op6_stupid_backoff, "op7_minhash": op7_minhash, "op8_topk": op8_topk, "op9_langid": op9_langid, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL}
