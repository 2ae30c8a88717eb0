"""The queries of the corpus operators and their oracles."""

from __future__ import annotations

from regionframe.llm import audio, bitpack, divergence, forest, infill, mixing, neardup, packing, repeats, topk, toxicity, transducer, urls

QUERIES = {"op1_token_counts": transducer.op1_token_counts, "op2_packing": packing.op2_packing, "op10_bitpack": bitpack.op10_bitpack, "op3_topk": topk.op3_topk, "op4_neardup": neardup.op4_neardup, "op5_audio": audio.op5_audio, "op6_toxicity": toxicity.op6_toxicity, "op9_repeats": repeats.op9_repeats, "op7_mixing": mixing.op7_mixing, "op8_urls": urls.op8_urls, "op11_divergence": divergence.op11_divergence, "op12_forest": forest.op12_forest, "op13_infill": infill.op13_infill}
ORACLES = {"op3_topk": topk.ORACLE, "op11_divergence": divergence.ORACLE, "op13_infill": infill.ORACLE}
