"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from haploweave.llm import ann, bit_slices, chat, exact_dedup, merkle, mixing, packing, pii, prefix_trie, quality, simhash, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_pack": packing.op3_pack,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_chat_format": chat.op5_chat_format,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_simhash": simhash.op8_simhash,
    "op9_ann": ann.op9_ann,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_manifest": merkle.op11_manifest,
    "op12_top_products": bit_slices.op12_top_products,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE = {
    "op5_chat_format": chat.SQL,
    "op7_mix_sources": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_manifest": merkle.SQL,
    "op12_top_products": bit_slices.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
