"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, language_id, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_quality_classifier": quality_classifier.op2,
    "op3_benchmark_decontamination": decontamination.op3,
    "op4_toxicity": toxicity.op4,
    "op5_pii": pii.op5,
    "op6_sharding": sharding.op6,
    "op7_language_id": language_id.op7,
    "op8_license_scans": license_scan.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_packing": packing.op10,
    "quality_ablations": quality_rules.quality_ablations,
    "packing_conversations": packing.packing_conversations,
}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scans": license_scan.oracle_sql(), "op9_quality_rules": quality_rules.ORACLE_SQL, "quality_ablations": quality_rules.ABLATIONS_SQL}
