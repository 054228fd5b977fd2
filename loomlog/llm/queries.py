"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from . import hostrules, leaks, mixing, neardup, negatives, packing, phrases, pii, quality, revisits, runs, vafile, wordpieces

QUERIES = {
    "op1_repeated_phrases": phrases.op1_repeated_phrases,
    "op2_longest_match": wordpieces.op2_longest_match,
    "op3_not_modified": revisits.op3_not_modified,
    "op4_sum_of_squares": packing.op4_sum_of_squares,
    "op5_setsketch": neardup.op5_setsketch,
    "op6_quadratic_discriminant": quality.op6_quadratic_discriminant,
    "op7_pfair": mixing.op7_pfair,
    "op8_vector_approximation": vafile.op8_vector_approximation,
    "op9_personal_data": pii.op9_personal_data,
    "op10_host_rules": hostrules.op10_host_rules,
    "op11_leaks": leaks.op11_leaks,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_repeated_phrases": phrases.ORACLE,
    "op3_not_modified": revisits.ORACLE,
    "op5_setsketch": neardup.ORACLE,
    "op8_vector_approximation": vafile.ORACLE,
    "op10_host_rules": hostrules.ORACLE,
    "op11_leaks": leaks.ORACLE,
    "op12_periodic_runs": runs.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
