"""The queries of the llm operators and their SQL."""

from __future__ import annotations

from stylomill.llm import checks
from stylomill.llm.alignment import op13_token_alignment
from stylomill.llm.bpe import op3_bpe
from stylomill.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from stylomill.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from stylomill.llm.langid import op10_language_id
from stylomill.llm.line_dedup import OP7_SQL, op7_line_dedup
from stylomill.llm.lm import op5_lm_score
from stylomill.llm.media import op8_media_chunks
from stylomill.llm.mixing import op4_mix_sources
from stylomill.llm.secrets import op6_secret_scan
from stylomill.llm.sharding import op9_shard_compaction
from stylomill.llm.token_store import op11_token_store
from stylomill.llm.variants import OP12_SQL, op12_spelling_variants

QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_exact_dedup": op2_exact_dedup, "op3_bpe": op3_bpe, "op4_mix_sources": op4_mix_sources, "op5_lm_score": op5_lm_score, "op6_secret_scan": op6_secret_scan, "op7_line_dedup": op7_line_dedup, "op8_media_chunks": op8_media_chunks, "op9_shard_compaction": op9_shard_compaction, "op10_language_id": op10_language_id, "op11_token_store": op11_token_store, "op12_spelling_variants": op12_spelling_variants, "op13_token_alignment": op13_token_alignment} | checks.QUERIES
ORACLE_SQL = {"op1_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op7_line_dedup": OP7_SQL, "op12_spelling_variants": OP12_SQL} | checks.ORACLE_SQL
