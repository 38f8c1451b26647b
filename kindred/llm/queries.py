"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from kindred.llm.chat import OP7_SQL, op7_chat_formatting
from kindred.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from kindred.llm.importance import OP11_SQL, op11_importance_resampling
from kindred.llm.langid import op4_language_id
from kindred.llm.licenses import OP13_SQL, op13_license_scan
from kindred.llm.media import op8_media_columns
from kindred.llm.packing import op5_best_fit_packing
from kindred.llm.runs import op12_periodic_runs
from kindred.llm.sentencepiece import op3_sentencepiece
from kindred.llm.sharding import op6_sharding
from kindred.llm.simhash import op2_simhash_near_dedup
from kindred.llm.suffix_dedup import OP9_SQL, op9_suffix_array_dedup
from kindred.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash_near_dedup, op3_sentencepiece, op4_language_id, op5_best_fit_packing,
        op6_sharding, op7_chat_formatting, op8_media_columns, op9_suffix_array_dedup, op10_exact_dedup,
        op11_importance_resampling, op12_periodic_runs, op13_license_scan,
    )
}
ORACLE_SQL = {"op7_chat_formatting": OP7_SQL, "op9_suffix_array_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_license_scan": OP13_SQL}
