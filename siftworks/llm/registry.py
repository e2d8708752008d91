"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, conversation_trie, decontaminate, imatch, langid, nearest, packing, secret_scan, simhash, substring_dedup, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_packing": packing.op2_packing,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_imatch": imatch.op7_imatch,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_simhash": simhash.op10_simhash,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_nearest": nearest.op12_nearest,
        "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.OP3_SQL, "op11_conversation_repair": conversation_repair.OP11_SQL, "op12_nearest": nearest.OP12_SQL, "op13_conversation_trie": conversation_trie.OP13_SQL}
