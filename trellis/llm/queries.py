"""The operators' registered queries and their SQL."""

from __future__ import annotations

from trellis.llm.chat import OP1_SQL, op1_chat_windows
from trellis.llm.decontamination import op4_spaced_seed_decontamination
from trellis.llm.embedding_dedup import OP9_SQL, op9_cover_tree_dedup
from trellis.llm.forest import op11_projection_forest_search
from trellis.llm.jaccard_join import OP8_SQL, op8_set_relation_join
from trellis.llm.language_id import op2_byte_gru_language
from trellis.llm.lexical import OP13_SQL, op13_bag_dedup_search
from trellis.llm.merkle import OP12_SQL, op12_veb_merkle_manifest
from trellis.llm.packing import op6_tiered_packing
from trellis.llm.quality import op10_kneser_ney_quality
from trellis.llm.sharding import op7_rendezvous_sharding
from trellis.llm.suffix_dedup import op5_suffix_dedup
from trellis.llm.token_counts import op3_token_counts

OPERATORS = (
    op1_chat_windows, op2_byte_gru_language, op3_token_counts, op4_spaced_seed_decontamination,
    op5_suffix_dedup,
    op6_tiered_packing, op7_rendezvous_sharding, op8_set_relation_join, op9_cover_tree_dedup, op10_kneser_ney_quality,
    op11_projection_forest_search, op12_veb_merkle_manifest, op13_bag_dedup_search,
)


def queries():
    return {f.__name__: f for f in OPERATORS}


def oracle_sql():
    return {"op1_chat_windows": OP1_SQL, "op8_set_relation_join": OP8_SQL, "op9_cover_tree_dedup": OP9_SQL, "op12_veb_merkle_manifest": OP12_SQL, "op13_bag_dedup_search": OP13_SQL}
