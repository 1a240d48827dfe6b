"""Registered queries of the training-data operators and the SQL that states their results where SQL can."""

from __future__ import annotations

from . import hilbert, media, mixing, neardup, packing, pivots, preference, quality, repair, secrets, suffix, toxicity, trie

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffix": suffix.op2_suffix,
    "op3_hilbert": hilbert.op3_hilbert,
    "op4_neardup": neardup.op4_neardup,
    "op5_pivots": pivots.op5_pivots,
    "op6_media": media.op6_media,
    "op7_packing": packing.op7_packing,
    "op8_preference": preference.op8_preference,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_trie": trie.op11_trie,
    "op12_repair": repair.op12_repair,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {"op5_pivots": pivots.ORACLE, "op8_preference": preference.ORACLE, "op9_mixing": mixing.ORACLE, "op11_trie": trie.ORACLE}
