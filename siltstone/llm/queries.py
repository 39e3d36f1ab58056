"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from siltstone.llm import decontaminate, jaccard_join, kd_shards, language_id, merkle, oracles, packing, periodic_runs, personal_data, preferences, quality, secret_scan, token_counts, token_output

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_kd_shards": kd_shards.op2_kd_shards,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_packing": packing.op5_packing,
    "op6_personal_data": personal_data.op6_personal_data,
    "op7_preferences": preferences.op7_preferences,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_language_id": language_id.op12_language_id,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op7_preferences": oracles.PREFERENCES, "op8_quality_rules": oracles.QUALITY, "op10_jaccard_join": oracles.SHINGLES, "op13_merkle_manifest": merkle.ORACLE}
