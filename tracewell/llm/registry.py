"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm.chosenpath import op6_ngram_join
from tracewell.llm.decontam import op10_decontamination
from tracewell.llm.hnsw import op2_embedding_dedup
from tracewell.llm.langid import op7_language_id
from tracewell.llm.lines import op8_line_dedup
from tracewell.llm.lmscore import op1_lm_scoring
from tracewell.llm.oracle import SQL
from tracewell.llm.pieces import op9_pieces
from tracewell.llm.pii import op3_pii
from tracewell.llm.sharding import op4_sharding
from tracewell.llm.suffixes import op5_suffix_dedup

_OPERATORS = (
    op1_lm_scoring,
    op2_embedding_dedup,
    op3_pii,
    op4_sharding,
    op5_suffix_dedup,
    op6_ngram_join,
    op7_language_id,
    op8_line_dedup,
    op9_pieces,
    op10_decontamination,
)
QUERIES = {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLE = SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
