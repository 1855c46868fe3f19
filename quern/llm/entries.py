"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm import bins, media, mixing, packing, periods, pii, quality, ranking, secrets, simhash, token_files, toolcalls, tries


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_simhash": simhash.op3_simhash,
        "op4_tool_calls": toolcalls.op4_tool_calls,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality_classifier": ranking.op6_quality_classifier,
        "op7_pii": pii.op7_pii,
        "op8_packing": packing.op8_packing,
        "op9_token_files": token_files.op9_token_files,
        "op10_mixing": mixing.op10_mixing,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_best_fit": bins.op12_best_fit,
        "op13_prefix_trie": tries.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_tool_calls": toolcalls.ORACLE, "op5_secret_scan": secrets.oracle(), "op10_mixing": mixing.ORACLE, "op13_prefix_trie": tries.ORACLE}
