"""The queries of this package and their SQL, where SQL can say them."""

from . import exact, langid, mixing, packing, pii, pivots, quality, simhash, substrings, tokens

QUERIES = {
    "op1_simhash_dedup": simhash.op1,
    "op2_exact_dedup": exact.op2,
    "op3_top_products": pivots.op3,
    "op4_token_counts": tokens.op4,
    "op5_mix_sources": mixing.op5,
    "op6_substring_dedup": substrings.op6,
    "op7_pii_pseudonyms": pii.op7,
    "op8_language_id": langid.op8,
    "op9_pack": packing.op9,
    "op10_quality": quality.op10,
}

SQL = {"op2_exact_dedup": exact.SQL, "op3_top_products": pivots.SQL, "op6_substring_dedup": substrings.SQL}
