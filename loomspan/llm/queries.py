"""The queries of this subpackage and the SQL that says the same, by name."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, licenses, packing, pii, secrets, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_pii": pii.op4_pii,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_output": token_output.op9_token_output,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
SQL = {"op1_jaccard_join": jaccard_join.SQL, "op5_exact_dedup": exact_dedup.SQL}
