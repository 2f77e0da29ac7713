"""The registered queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from . import ann, chat, hosts, importance, langid, mixing, neardup, packing, pii, quality, rules, tokenbin, trie

QUERIES = {
    "op1_preference_format": chat.query,
    "op2_bilstm_crf_pii": pii.query,
    "op3_ecoc_language": langid.query,
    "op4_order_minhash": neardup.query,
    "op5_best_fit_pack": packing.query,
    "op6_weighted_fair_mix": mixing.query,
    "op7_subword_quality": quality.query,
    "op8_huffman_tokens": tokenbin.query,
    "op9_adaptive_scan": ann.query,
    "op10_divergence_rules": rules.query,
    "op11_importance_resample": importance.query,
    "op12_prefix_trie": trie.query,
    "op13_host_reputation": hosts.query,
}
ORACLES = {
    "op1_preference_format": chat.ORACLE,
    "op6_weighted_fair_mix": mixing.ORACLE,
    "op11_importance_resample": importance.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_host_reputation": hosts.ORACLE,
}
