"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_text, jpeg, mixing, packing, periodic_runs, pii, prefix_trie, quality, simhash, suffix_dedup, token_files, toxicity, url_filter

QUERIES = {f.__name__: f for f in (
    token_files.op1_separator_scan,
    jpeg.op2_baseline_jpeg,
    html_text.op3_html_extraction,
    quality.op4_repetition_rules,
    toxicity.op5_gru_toxicity,
    suffix_dedup.op6_suffix_dedup,
    mixing.op7_entropy_mixing,
    packing.op8_best_fit_packing,
    simhash.op9_simhash_near_dedup,
    pii.op10_personal_data,
    periodic_runs.op11_periodic_runs,
    prefix_trie.op12_prefix_trie,
    url_filter.op13_url_filters,
)}

ORACLES: dict[str, str] = {"op4_repetition_rules": quality.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_url_filters": url_filter.ORACLE}
