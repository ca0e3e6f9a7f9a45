"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import dedup, host_rules, jaccard, licenses, lm, mixing, packing, quality, sharding, toxicity

QUERIES = {
    "op1_cost_packing": packing.op1_cost_packing,
    "op2_quadratic_discriminant": quality.op2_quadratic_discriminant,
    "op3_deleted_interpolation": lm.op3_deleted_interpolation,
    "op4_license_paragraphs": licenses.op4_license_paragraphs,
    "op5_poisson_mixing": mixing.op5_poisson_mixing,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_exact_dedup": dedup.op7_exact_dedup,
    "op8_recurrent_toxicity": toxicity.op8_recurrent_toxicity,
    "op9_jump_sharding": sharding.op9_jump_sharding,
    "op10_host_rules": host_rules.op10_host_rules,
}

SQL = {"op5_poisson_mixing": mixing.OP5_SQL, "op6_ngram_jaccard": jaccard.OP6_SQL, "op7_exact_dedup": dedup.OP7_SQL, "op10_host_rules": host_rules.OP10_SQL}
