"""The registered queries of this subpackage."""

import corpus_pipeline
from feedlake.llm import (
    chat,
    collocations,
    decontaminate,
    fill_middle,
    fingerprints,
    jaccard,
    line_dedup,
    packing,
    quality,
    suffix_dedup,
    token_files,
    toxicity,
    window_dedup,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_chat_format": chat.op4_chat_format,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_token_files": token_files.op6_token_files,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_window_dedup": window_dedup.op12_window_dedup,
    "op13_fill_middle": fill_middle.op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_chat_format": chat.OP4_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_window_dedup": window_dedup.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
