"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, byte_repeats, exact_topk, jaccard, langid, lm, lsh, mixing, periodic, quality, substring, token_files, trie

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_exact_topk": exact_topk.op2_exact_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_substring": substring.op5_substring,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_lsh": lsh.op7_lsh,
    "op8_language_id": langid.op8_language_id,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_suffix_array": byte_repeats.op11_suffix_array,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_periodic": periodic.op13_periodic,
}
ORACLES = {
    "op2_exact_topk": exact_topk.SQL,
    "op3_mixing": mixing.SQL,
    "op5_substring": substring.SQL,
    "op9_jaccard": jaccard.SQL,
    "op11_suffix_array": byte_repeats.SQL,
    "op12_prefix_trie": trie.SQL,
}
