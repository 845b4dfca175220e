"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from synthloom.llm import extraction, jaccard, language, media, mixing, packing, pii, quality, sharding, substrings, toxicity, trie, variants

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_extraction": extraction.op3_extraction,
    "op4_pii": pii.op4_pii,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_language": language.op6_language,
    "op7_quality": quality.op7_quality,
    "op8_media": media.op8_media,
    "op9_substrings": substrings.op9_substrings,
    "op10_mixing": mixing.op10_mixing,
    "op11_variants": variants.op11_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_trie": trie.op13_trie,
}

SQL = {
    "op5_jaccard": jaccard.OP5_SQL,
    "op7_quality": quality.OP7_SQL,
    "op9_substrings": substrings.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_variants": variants.OP11_SQL,
    "op13_trie": trie.OP13_SQL,
}
