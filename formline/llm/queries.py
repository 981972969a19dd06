"""Queries of the operators over the tables of a folder, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import embdedup, langid, licenses, linededup, mixing, neardup, packing, pii, quality, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_neardup": neardup.op5_neardup,
    "op6_langid": langid.op6_langid,
    "op7_licenses": licenses.op7_licenses,
    "op8_embdedup": embdedup.op8_embdedup,
    "op9_linededup": linededup.op9_linededup,
    "op10_toxicity": toxicity.op10_toxicity,
    "quality_ablations": quality.quality_ablations,
}

#: The others are held against brute force, exact round trips or held-out accuracy in the tests.
ORACLE_SQL = {
    "op3_quality": quality.SQL,
    "op8_embdedup": embdedup.SQL,
    "op9_linededup": linededup.SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
