"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from rotorline.llm import ctw, decontaminate, embeddup, htmltext, mixing, pieces, quality, runs, search, sharding, simhash, toxicity, urlfilter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_html_text": htmltext.op2_html_text,
    "op3_quality": quality.op3_quality,
    "op4_lm_scoring": ctw.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_embedding_dedup": embeddup.op6_embedding_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_sharding": sharding.op9_sharding,
    "op10_simhash": simhash.op10_simhash,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op6_embedding_dedup": embeddup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op11_ranked_search": search.ORACLE,
}
