"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.bpe import op10_bpe
from tidemark.llm.hmm_score import op5_hmm_score
from tidemark.llm.itq_dedup import OP1_SQL, op1_itq_dedup
from tidemark.llm.near_dedup import OP6_SQL, op6_near_dedup
from tidemark.llm.paragraph_dedup import op2_paragraph_dedup
from tidemark.llm.quality import op9_quality
from tidemark.llm.secret_scan import op4_secret_scan
from tidemark.llm.source_mix import OP8_SQL, op8_source_mix
from tidemark.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from tidemark.llm.topk_search import OP3_SQL, op3_topk

QUERIES = {
    "op1_itq_dedup": op1_itq_dedup,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_topk": op3_topk,
    "op4_secret_scan": op4_secret_scan,
    "op5_hmm_score": op5_hmm_score,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {"op1_itq_dedup": OP1_SQL, "op3_topk": OP3_SQL, "op6_near_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_source_mix": OP8_SQL}
