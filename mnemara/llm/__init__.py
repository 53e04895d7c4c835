"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries():
    from mnemara.llm import chat, colloc, decontam, embdedup, langid, licenses, mixing, mtree, nbest, simhash, toxicity, wavelet, whitening

    return {
        "op1_wavelet": wavelet.op1_wavelet,
        "op2_mix": mixing.op2_mix,
        "op3_language": langid.op3_language,
        "op4_licenses": licenses.op4_licenses,
        "op5_nbest": nbest.op5_nbest,
        "op6_simhash": simhash.op6_simhash,
        "op7_mtree": mtree.op7_mtree,
        "op8_embedding_dedup": embdedup.op8_embedding_dedup,
        "op9_chat_format": chat.op9_chat_format,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_decontamination": decontam.op11_decontamination,
        "op12_collocations": colloc.op12_collocations,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql():
    from mnemara.llm import chat, colloc, decontam, embdedup, licenses, mixing, mtree

    return {
        "op2_mix": mixing.OP2_SQL,
        "op4_licenses": licenses.OP4_SQL,
        "op7_mtree": mtree.OP7_SQL,
        "op8_embedding_dedup": embdedup.OP8_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op11_decontamination": decontam.OP11_SQL,
        "op12_collocations": colloc.OP12_SQL,
    }
