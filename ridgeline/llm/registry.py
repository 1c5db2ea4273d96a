"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, langid, license_scan, line_dedup, lm_scoring, mixing, packing, sharding, simhash


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_sharding": sharding.op2_sharding,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_langid": langid.op4_langid,
        "op5_mixing": mixing.op5_mixing,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.OP2_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op10_embedding_dedup": embedding_dedup.OP10_SQL,
    }
