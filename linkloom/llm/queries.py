"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from linkloom.llm.ann import op10_multiprobe_pstable
from linkloom.llm.compression import op5_compression_quality, op7_compression_toxicity
from linkloom.llm.mixing import OP4_SQL, op4_water_filled_mix
from linkloom.llm.near_dedup import OP6_SQL, op6_minhash_inverted_join
from linkloom.llm.packing import op2_best_fit_packing
from linkloom.llm.pii import op9_disclosure_control
from linkloom.llm.preference import OP1_SQL, op1_preference_format
from linkloom.llm.quality_rules import op3_robust_outliers
from linkloom.llm.sharding import op8_bounded_ring_shards

_ALL = (
    op1_preference_format,
    op2_best_fit_packing,
    op3_robust_outliers,
    op4_water_filled_mix,
    op5_compression_quality,
    op6_minhash_inverted_join,
    op7_compression_toxicity,
    op8_bounded_ring_shards,
    op9_disclosure_control,
    op10_multiprobe_pstable,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_preference_format": OP1_SQL, "op4_water_filled_mix": OP4_SQL, "op6_minhash_inverted_join": OP6_SQL}
