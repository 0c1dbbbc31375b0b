"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from linelake.llm.chat import op12_chat_formatting
from linelake.llm.decontaminate import op7_benchmark_decontamination
from linelake.llm.hmm import op8_hmm_scoring
from linelake.llm.jaccard import op3_ngram_jaccard_join
from linelake.llm.license import op6_license_scan
from linelake.llm.media import op10_media_columns
from linelake.llm.merkle import op13_merkle_manifest
from linelake.llm.oracle import ORACLE as ORACLE
from linelake.llm.packing import op2_best_fit_packing
from linelake.llm.phrases import op11_phrase_mining
from linelake.llm.quality import op1_quality_classifier
from linelake.llm.recompress import op4_substring_dedup
from linelake.llm.toxicity import op9_toxicity
from linelake.llm.warc import op5_warc

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc": op5_warc,
    "op6_license_scan": op6_license_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_hmm_scoring": op8_hmm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_media_columns": op10_media_columns,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_merkle_manifest": op13_merkle_manifest,
}

