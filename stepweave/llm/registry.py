"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from stepweave.llm import chat, jaccard, media, mixing, packing, pii, quality, secrets, sharding, token_files

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_secret_scan": secrets.query,
    "op3_packing": packing.query,
    "op4_chat_format": chat.query,
    "op5_mixing": mixing.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_token_files": token_files.query,
    "op8_flac": media.query,
    "op9_pii": pii.query,
    "op10_quality": quality.query,
}

#: Where SQL can express the query: it has no tokenizer, codec or fitted trees. tests/llm hold the others against brute force.
ORACLE = {
    "op1_sharding": sharding.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_ngram_jaccard": jaccard.ORACLE,
    "op10_quality": quality.ORACLE,
}
