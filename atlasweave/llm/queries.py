"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from atlasweave.llm.bpe import op3_byte_bpe
from atlasweave.llm.decontamination import op6_benchmark_decontamination
from atlasweave.llm.html_text import op10_html_extraction
from atlasweave.llm.jaccard_join import op2_ngram_jaccard_join
from atlasweave.llm.kneser_ney import op4_lm_scoring
from atlasweave.llm.language_id import op5_language_id
from atlasweave.llm.license_scan import op9_license_scan
from atlasweave.llm.quality_rules import op1_quality_rules
from atlasweave.llm.token_counts import op7_token_counts
from atlasweave.llm.weak_quality import op8_quality_classifier

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard_join, op3_byte_bpe, op4_lm_scoring, op5_language_id, op6_benchmark_decontamination, op7_token_counts, op8_quality_classifier, op9_license_scan, op10_html_extraction)}

ORACLES: dict[str, str] = {}
