"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from floorspan.llm.chat_format import op3_chat_format
from floorspan.llm.decontaminate import op7_decontaminate
from floorspan.llm.language_id import op9_language_id
from floorspan.llm.language_model import op1_lm_score
from floorspan.llm.mixing import op2_mix_sources
from floorspan.llm.ngram_join import op5_ngram_join
from floorspan.llm.quality_rank import op6_quality_rank
from floorspan.llm.quality_rules import op10_quality_rules
from floorspan.llm.resampling import op11_importance_resample
from floorspan.llm.spelling import op12_spelling_groups
from floorspan.llm.sql import ORACLE_SQL
from floorspan.llm.token_counts import op4_token_counts
from floorspan.llm.toxicity import op8_toxicity
from floorspan.llm.url_filter import op13_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_lm_score, op2_mix_sources, op3_chat_format, op4_token_counts, op5_ngram_join, op6_quality_rank, op7_decontaminate, op8_toxicity, op9_language_id, op10_quality_rules, op11_importance_resample, op12_spelling_groups, op13_url_filter)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
