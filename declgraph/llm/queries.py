"""The queries of this subpackage and their SQL."""

from declgraph.llm import ann, chat, exact, langid, mixing, pieces, sharding, simhash, substrings, tokens

QUERIES = {
    "op1_chat_preferences": chat.op1,
    "op2_sentencepiece": pieces.op2,
    "op3_token_ids": tokens.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_multi_index": ann.op5,
    "op6_language_id": langid.op6,
    "op7_shard": sharding.op7,
    "op8_simhash": simhash.op8,
    "op9_mix": mixing.op9,
    "op10_exact_dedup": exact.op10,
}
SQL = {"op1_chat_preferences": chat.OP1_SQL, "op10_exact_dedup": exact.OP10_SQL}
