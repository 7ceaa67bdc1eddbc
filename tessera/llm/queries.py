"""The operators' queries: QUERIES by name, and ORACLES with SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.host_quality import op4_host_quality
from tessera.llm.licenses import op3_license_scan
from tessera.llm.line_dedup import op8_fuzzy_line_dedup
from tessera.llm.lm_scoring import op9_ngram_trie_scores
from tessera.llm.mixing import op7_entropy_mixing
from tessera.llm.packing import op10_lexical_packing
from tessera.llm.sharding import ORACLE as SHARDING_SQL
from tessera.llm.sharding import op2_extendible_shards
from tessera.llm.simhash import op1_simhash_near_dedup
from tessera.llm.topk_nra import op6_nra_top_k
from tessera.llm.url_rules import op5_url_rules

_ALL = (
    op1_simhash_near_dedup,
    op2_extendible_shards,
    op3_license_scan,
    op4_host_quality,
    op5_url_rules,
    op6_nra_top_k,
    op7_entropy_mixing,
    op8_fuzzy_line_dedup,
    op9_ngram_trie_scores,
    op10_lexical_packing,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op2_extendible_shards": SHARDING_SQL}
