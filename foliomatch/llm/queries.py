"""The queries of this subpackage and, where SQL can express them, their SQL for the same tables."""

from foliomatch.llm import ann, chat, lm, matroska, mixing, packing, pii, quality, resample, secret_scan, simhash, spelling, warc

QUERIES = {
    "op1_warc_derivatives": warc.op1_warc_derivatives,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_pack": packing.op3_pack,
    "op4_pseudo_likelihood": lm.op4_pseudo_likelihood,
    "op5_matroska": matroska.op5_matroska,
    "op6_quality": quality.op6_quality,
    "op7_ann_search": ann.op7_ann_search,
    "op8_simhash": simhash.op8_simhash,
    "op9_format_chat": chat.op9_format_chat,
    "op10_pseudonyms": pii.op10_pseudonyms,
    "op11_secrets": secret_scan.op11_secrets,
    "op12_resample": resample.op12_resample,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_warc_derivatives": warc.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op9_format_chat": chat.OP9_SQL,
    "op12_resample": resample.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
