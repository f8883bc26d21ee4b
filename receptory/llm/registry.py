"""Queries of this subpackage, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

from receptory.llm.bpe import op7_bpe
from receptory.llm.decontaminate import OP4_SQL, op4_decontaminate
from receptory.llm.katz import op6_katz
from receptory.llm.line_dedup import OP9_SQL, op9_line_dedup
from receptory.llm.ngram_jaccard import OP8_SQL, op8_ngram_jaccard
from receptory.llm.order_minhash import op2_order_minhash
from receptory.llm.pii import op3_pii_surrogates
from receptory.llm.quality import op10_quality
from receptory.llm.toxicity import op5_toxicity
from receptory.llm.warc import OP1_SQL, op1_warc

QUERIES = {"op1_warc": op1_warc, "op2_order_minhash": op2_order_minhash, "op3_pii_surrogates": op3_pii_surrogates, "op4_decontaminate": op4_decontaminate, "op5_toxicity": op5_toxicity, "op6_katz": op6_katz, "op7_bpe": op7_bpe, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_line_dedup": op9_line_dedup, "op10_quality": op10_quality}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op4_decontaminate": OP4_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_line_dedup": OP9_SQL}
