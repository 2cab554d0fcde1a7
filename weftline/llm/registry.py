"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from weftline.llm.language_id import op5_language_id
from weftline.llm.lm_score import op4_lm_score
from weftline.llm.mixing import OP10_SQL, op10_mix_sources
from weftline.llm.near_dedup import op1_near_dedup
from weftline.llm.packing import op7_packing
from weftline.llm.quality import op2_quality
from weftline.llm.token_shards import op6_token_shards
from weftline.llm.topk_search import OP3_SQL, op3_topk_search
from weftline.llm.web_archive import op8_web_archive

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_topk_search": op3_topk_search,
    "op4_lm_score": op4_lm_score,
    "op5_language_id": op5_language_id,
    "op6_token_shards": op6_token_shards,
    "op7_packing": op7_packing,
    "op8_web_archive": op8_web_archive,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL = {
    "op3_topk_search": OP3_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
}
