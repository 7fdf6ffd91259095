"""The training-data queries, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lm import op6_deleted_interpolation
from .minhash import op1_minhash_lsh_forest
from .mixing import OP9_SQL, op9_hash_threshold_mixing
from .quality import op4_distribution_divergence
from .packing import op2_best_fit_packing
from .rollup import op10_delta_rollup
from .sharding import op8_vector_bin_sharding
from .suffix import op5_suffix_merge_dedup
from .vptree import op7_vantage_point_search
from .warc import op3_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_lsh_forest,
        op2_best_fit_packing,
        op3_warc_derivatives,
        op4_distribution_divergence,
        op5_suffix_merge_dedup,
        op6_deleted_interpolation,
        op7_vantage_point_search,
        op8_vector_bin_sharding,
        op9_hash_threshold_mixing,
        op10_delta_rollup,
    )
}

#: op10 counts tokens by public vocabularies, which SQL can't; tests hold it against whole-text counts and SQL on them.
ORACLE_SQL: dict[str, str] = {"op9_hash_threshold_mixing": OP9_SQL}
