"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from molframe.llm import fim, fingerprints, langid, lm, media, mixing, ngramjoin, phrases, rollups, sentencepiece, simhash, toxicity, urlfilter


def queries():
    return {
        "op1_sentencepiece": sentencepiece.op1,
        "op2_media": media.op2,
        "op3_lm_scoring": lm.op3,
        "op4_token_counts": rollups.op4,
        "op5_url_filters": urlfilter.op5,
        "op6_simhash_near_dedup": simhash.op6,
        "op7_mixing": mixing.op7,
        "op8_language_id": langid.op8,
        "op9_toxicity": toxicity.op9,
        "op10_fingerprints": fingerprints.op10,
        "op11_jaccard_join": ngramjoin.op11,
        "op12_collocations": phrases.op12,
        "op13_fill_in_middle": fim.op13,
    }


def oracle_sql():
    return {
        "op4_token_counts": rollups.OP4_SQL,
        "op5_url_filters": urlfilter.OP5_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op11_jaccard_join": ngramjoin.OP11_SQL,
        "op12_collocations": phrases.OP12_SQL,
        "op13_fill_in_middle": fim.OP13_SQL,
    }
