"""Registered corpus queries and the SQL of those that SQL can express."""

from cadastre.llm import collocations, decontaminate, divergence, language, license_scan, packing, passages, quality_model, quality_rules, set_join, sharding, url_filter, warc

QUERIES = {
    "op1_host_reputation": url_filter.op1_host_reputation,
    "op2_set_relations": set_join.op2_set_relations,
    "op3_word_backoff": language.op3_word_backoff,
    "op4_concatenate_and_cut": packing.op4_concatenate_and_cut,
    "op5_spaced_seeds": decontaminate.op5_spaced_seeds,
    "op6_adaptive_rules": quality_rules.op6_adaptive_rules,
    "op7_fourier_ridge": quality_model.op7_fourier_ridge,
    "op8_window_minhash": license_scan.op8_window_minhash,
    "op9_compact_windows": passages.op9_compact_windows,
    "op10_sampled_splitters": sharding.op10_sampled_splitters,
    "op11_boundary_chain": warc.op11_boundary_chain,
    "op12_setm": collocations.op12_setm,
    "op13_joint_quadtree": divergence.op13_joint_quadtree,
}
ORACLES = {
    "op1_host_reputation": url_filter.SQL,
    "op2_set_relations": set_join.SQL,
    "op5_spaced_seeds": decontaminate.SQL,
    "op6_adaptive_rules": quality_rules.SQL,
    "op8_window_minhash": license_scan.SQL,
    "op11_boundary_chain": warc.SQL,
    "op12_setm": collocations.SQL,
    "op13_joint_quadtree": divergence.SQL,
}
