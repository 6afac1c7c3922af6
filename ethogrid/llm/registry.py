"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from ethogrid.llm import balltree, decontaminate, hard_negatives, mixing, phrases, warc
from ethogrid.llm.balltree import op8_exact_top_k
from ethogrid.llm.decontaminate import op5_benchmark_decontamination
from ethogrid.llm.hard_negatives import op11_hard_negatives
from ethogrid.llm.htmltext import op4_html_extraction
from ethogrid.llm.mixing import op13_source_mix
from ethogrid.llm.packing import op6_best_fit_packing
from ethogrid.llm.phrases import op12_phrase_collocations
from ethogrid.llm.quality import op1_quality_classifier
from ethogrid.llm.sstable import op2_token_sstable
from ethogrid.llm.simhash import op7_simhash_near_dedup
from ethogrid.llm.suffix_dedup import op10_suffix_array_dedup
from ethogrid.llm.toxicity import op3_toxicity
from ethogrid.llm.warc import op9_warc

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_sstable": op2_token_sstable,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_warc": op9_warc,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_source_mix": op13_source_mix,
}

ORACLE_SQL = {
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op8_exact_top_k": balltree.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_source_mix": mixing.ORACLE,
}
