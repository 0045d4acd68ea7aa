"""Registered queries of the document operators and their SQL twins."""

from __future__ import annotations

from . import decontaminate, divergence, importance, licenses, line_dedup, packing, quality_rules, repeats, rule_ensemble, sharding, simhash, token_counts, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_reshard": sharding.op2_reshard,
    "op3_warc": warc.op3_warc,
    "op4_quality_classifier": rule_ensemble.op4_quality_classifier,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_repeated_passages": repeats.op10_repeated_passages,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_warc": warc.SQL,
    "op7_license_scan": licenses.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_source_divergence": divergence.SQL,
}
