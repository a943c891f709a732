"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import (
    exact_dedup,
    html_text,
    media,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    quality,
    ranked_search,
    secrets,
    suffix_dedup,
    token_shards,
    warc,
)
from driftwell.session import ship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_media": media.op1_media,
        "op2_packing": packing.op2_packing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_secrets": secrets.op5_secrets,
        "op6_warc": warc.op6_warc,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality": quality.op9_quality,
        "op10_token_shards": token_shards.op10_token_shards,
        "op11_main_text": html_text.op11_main_text,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }
    return {name: lambda spark, sf_dir, run=run: run(ship(spark), sf_dir) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE_OP3, "op13_ranked_search": ranked_search.ORACLE_OP13}
