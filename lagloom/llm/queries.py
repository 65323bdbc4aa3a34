"""The registered queries of this subpackage and their SQL counterparts."""

from .bpe import op9_backtracking_bpe
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .jaccard_join import op8_divide_skip_join
from .language_id import op12_partial_matching
from .merkle import OP13_SQL, op13_superblock_manifest
from .packing import op4_bin_completion
from .periodic_runs import op11_periodic_runs
from .secret_scan import op1_secret_scan
from .sharding import op7_stratified_shards
from .token_counts import op6_prefix_token_counts
from .token_store import op2_token_store
from .topk import OP10_SQL, op10_uniform_threshold
from .toxicity import op3_factorization_machine

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_store": op2_token_store,
    "op3_factorization_machine": op3_factorization_machine,
    "op4_bin_completion": op4_bin_completion,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_prefix_token_counts": op6_prefix_token_counts,
    "op7_stratified_shards": op7_stratified_shards,
    "op8_divide_skip_join": op8_divide_skip_join,
    "op9_backtracking_bpe": op9_backtracking_bpe,
    "op10_uniform_threshold": op10_uniform_threshold,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_partial_matching": op12_partial_matching,
    "op13_superblock_manifest": op13_superblock_manifest,
}

ORACLES = {
    "op5_exact_dedup": OP5_SQL,
    "op10_uniform_threshold": OP10_SQL,
    "op13_superblock_manifest": OP13_SQL,
}
