"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

import corpus_pipeline

from .filteraudit import OP12_SQL, op12_filter_interaction_audit
from .fim import OP11_SQL, op11_fill_in_middle
from .fingerprints import op9_canonical_digest
from .langid import op1_rank_order_language_id
from .linededup import OP13_SQL, op13_line_dedup
from .packing import op10_best_fit_packing
from .quality import op8_quality_classifier
from .sentencepieces import op5_sentencepiece_lattice
from .sharding import op6_rendezvous_sharding
from .simhash import op2_simhash_trie_join
from .topk import OP3_SQL, op3_bit_sliced_topk
from .toxicity import op4_noisy_or_toxicity
from .urlfilter import OP7_SQL, op7_temporal_url_filter

OPERATORS = (
    op1_rank_order_language_id,
    op2_simhash_trie_join,
    op3_bit_sliced_topk,
    op4_noisy_or_toxicity,
    op5_sentencepiece_lattice,
    op6_rendezvous_sharding,
    op7_temporal_url_filter,
    op8_quality_classifier,
    op9_canonical_digest,
    op10_best_fit_packing,
    op11_fill_in_middle,
    op12_filter_interaction_audit,
    op13_line_dedup,
)
QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {"op3_bit_sliced_topk": OP3_SQL, "op7_temporal_url_filter": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_filter_interaction_audit": OP12_SQL, "op13_line_dedup": OP13_SQL}
