"""The queries of this subpackage and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .fingerprints import op7_fingerprints
from .jaccard_join import OP1_SQL, op1_jaccard_join
from .lm_scoring import OP6_SQL, op6_lm_scoring
from .mixing import op5_source_mix
from .packing import op9_best_fit_packing
from .revisits import OP3_SQL, op3_warc_revisits
from .sharding import OP4_SQL, op4_extendible_sharding
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op8_toxicity

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_extendible_sharding": op4_extendible_sharding,
    "op5_source_mix": op5_source_mix,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLE_SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_warc_revisits": OP3_SQL,
    "op4_extendible_sharding": OP4_SQL,
    "op6_lm_scoring": OP6_SQL,
}
