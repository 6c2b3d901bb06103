"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithic.llm.decontaminate import op7_decontaminate
from lithic.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from lithic.llm.html_text import op4_html_text
from lithic.llm.mixing import OP1_SQL, op1_mix_sources
from lithic.llm.near_dedup import op3_minhash_near_dedup
from lithic.llm.oracles import OP3_SQL, OP5_SQL, OP7_SQL, OP10_SQL
from lithic.llm.quality import op2_quality_rules
from lithic.llm.secrets import op8_secret_scan
from lithic.llm.sharding import op6_shard_tree
from lithic.llm.substring_dedup import op10_substring_dedup
from lithic.llm.token_alignment import op12_token_alignment
from lithic.llm.token_counts import op9_token_counts
from lithic.llm.token_files import op13_token_files
from lithic.llm.warc import op5_warc_round_trip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_quality_rules": op2_quality_rules,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_html_text": op4_html_text,
        "op5_warc_round_trip": op5_warc_round_trip,
        "op6_shard_tree": op6_shard_tree,
        "op7_decontaminate": op7_decontaminate,
        "op8_secret_scan": op8_secret_scan,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_token_alignment": op12_token_alignment,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op5_warc_round_trip": OP5_SQL,
        "op7_decontaminate": OP7_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
    }
