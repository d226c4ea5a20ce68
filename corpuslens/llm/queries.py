"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op12_chat_formatting, op12_sql
from .embedding_dedup import op5_embedding_dedup
from .language_id import op4_language_id
from .line_dedup import op10_line_dedup, op10_sql
from .lm_scoring import op3_lm_scoring
from .minhash_dedup import op6_minhash_dedup
from .packing import op1_best_fit_packing
from .pii import op8_pii
from .quality_classifier import op7_quality_classifier
from .quality_rules import op2_quality_rules, op2_sql
from .resampling import op13_resampling, op13_sql
from .sentencepiece_stream import op9_sentencepiece
from .spelling import op11_spelling_variants, op11_sql

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_lm_scoring, op4_language_id, op5_embedding_dedup, op6_minhash_dedup, op7_quality_classifier, op8_pii, op9_sentencepiece, op10_line_dedup, op11_spelling_variants, op12_chat_formatting, op13_resampling)}


def oracles() -> dict[str, str]:
    return {"op2_quality_rules": op2_sql(), "op10_line_dedup": op10_sql(), "op11_spelling_variants": op11_sql(), "op12_chat_formatting": op12_sql(), "op13_resampling": op13_sql()}
