"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, katz, langid, licences, linededup, neardup, packing, pii, sharding, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_topk": topk.op2_topk,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_lm_scores": katz.op5_lm_scores,
    "op6_language": langid.op6_language,
    "op7_licences": licences.op7_licences,
    "op8_pii": pii.op8_pii,
    "op9_sharding": sharding.op9_sharding,
    "op10_neardup": neardup.op10_neardup,
}

ORACLE_SQL: dict[str, str] = {"op2_topk": topk.OP2_SQL}
