"""The subpackage's queries over the test tables, and the SQL of those that SQL can express."""

from tidemark.llm import (
    embedding_dedup,
    lexical,
    licenses,
    line_dedup,
    merkle,
    mixing,
    neural_lm,
    sentencepiece,
    simhash,
    substring_dedup,
    topk,
    toxicity,
    warc,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_warc": warc.op4_warc,
    "op5_licenses": licenses.op5_licenses,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_topk": topk.op8_topk,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_neural_lm": neural_lm.op11_neural_lm,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_warc": warc.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op8_topk": topk.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op12_lexical_search": lexical.SQL,
}
