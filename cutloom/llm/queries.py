"""The queries of this subpackage and the DuckDB text of those that SQL can state."""

from __future__ import annotations

from . import (byte_cnn, decontaminate, exact_dedup, fill_middle, filter_audit, jaccard_join, line_runs, page_text, personal_data, pieces,
               repeats, rule_ledger, toxicity)

QUERIES = {
    "op1_classifier_chain": toxicity.op1_classifier_chain,
    "op2_sparse_suffixes": repeats.op2_sparse_suffixes,
    "op3_line_runs": line_runs.op3_line_runs,
    "op4_page_differencing": page_text.op4_page_differencing,
    "op5_weak_supervision": personal_data.op5_weak_supervision,
    "op6_byte_cnn": byte_cnn.op6_byte_cnn,
    "op7_universe_partition": jaccard_join.op7_universe_partition,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_merge_dropout": pieces.op9_merge_dropout,
    "op10_suffix_decontamination": decontaminate.op10_suffix_decontamination,
    "op11_displacement_scatter": fill_middle.op11_displacement_scatter,
    "op12_rule_ledger": rule_ledger.op12_rule_ledger,
    "op13_byte_transducer": filter_audit.op13_byte_transducer,
}

ORACLES = {
    "op3_line_runs": line_runs.OP3_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_suffix_decontamination": decontaminate.OP10_SQL,
    "op11_displacement_scatter": fill_middle.OP11_SQL,
    "op12_rule_ledger": rule_ledger.OP12_SQL,
    "op13_byte_transducer": filter_audit.OP13_SQL,
}
