"""Queries of the corpus operators, one each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, leaders, lines, mixing, negatives, packing, preferences, pseudonyms, quality, secrets, sharding, simhash, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preferences": preferences.query,
        "op2_sharding": sharding.query,
        "op3_packing": packing.query,
        "op4_quality": quality.query,
        "op5_topk": topk.query,
        "op6_pseudonyms": pseudonyms.query,
        "op7_decontaminate": decontaminate.query,
        "op8_secrets": secrets.query,
        "op9_lines": lines.query,
        "op10_simhash": simhash.query,
        "op11_leaders": leaders.query,
        "op12_mixing": mixing.query,
        "op13_negatives": negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preferences": preferences.SQL, "op5_topk": topk.SQL, "op11_leaders": leaders.SQL, "op13_negatives": negatives.SQL}
