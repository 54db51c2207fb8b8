"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from graphloom.llm.embed_dedup import op9_embedding_near_dedup
from graphloom.llm.html_extract import op8_html_extraction
from graphloom.llm.langid import op6_language_id
from graphloom.llm.packing import op5_best_fit_packing
from graphloom.llm.quality import op3_quality
from graphloom.llm.sentencepiece import op2_sentencepiece
from graphloom.llm.simhash import op4_simhash_near_dedup
from graphloom.llm.topk import OP1_SQL, op1_topk_search
from graphloom.llm.toxicity import op10_toxicity
from graphloom.llm.warc import OP7_SQL, op7_warc_revisits


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk_search, op2_sentencepiece, op3_quality, op4_simhash_near_dedup, op5_best_fit_packing, op6_language_id, op7_warc_revisits, op8_html_extraction, op9_embedding_near_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op7_warc_revisits": OP7_SQL}
