"""The registered queries of this subpackage and their SQL."""

from blockwright.llm import bpe, chat, embed_dedup, license_scan, minhash, mixing, sharding, spotsigs, substring, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_bpe": bpe.op2_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_embedding_near_dedup": embed_dedup.op5_embedding_near_dedup,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_spotsigs": spotsigs.op9_spotsigs,
    "op10_substring_dedup": substring.op10_substring_dedup,
}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL}
