"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, mixing, near_dedup, prefix_trie, simhash, suffix_dedup, token_counts, token_files, topk, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_top_k": topk.op8_top_k,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_files": token_files.op10_token_files,
    "op11_simhash": simhash.op11_simhash,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_token_alignment": alignment.op13_token_alignment,
}
SQL = {**url_filter.SQL, **mixing.SQL, **exact_dedup.SQL, **topk.SQL, **prefix_trie.SQL}
