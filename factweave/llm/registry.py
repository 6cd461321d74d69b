"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this package that holds a function of that name.
MODULES = {
    "op1_html": "op1_html",
    "op2_quality": "op2_quality",
    "op3_linechunks": "op3_linechunks",
    "op4_media": "op4_media",
    "op5_sentencepiece": "op5_sentencepiece",
    "op6_simhash": "op6_simhash",
    "op7_langid": "op7_langid",
    "op8_repetition": "op8_repetition",
    "op9_lm": "op9_lm",
    "op10_mixing": "op10_mixing",
    "op11_negatives": "op11_negatives",
    "op12_decontaminate": "op12_decontaminate",
    "op13_whitening": "op13_whitening",
    "pipeline": "pipeline_query",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES.values():
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", {})
    return out
