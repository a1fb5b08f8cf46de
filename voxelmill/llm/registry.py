"""The query modules of this folder."""

from __future__ import annotations

import importlib

NAMES = ["sampling_queries", "ranking_queries", "diversity_queries", "split_queries", "mixture_queries", "token_queries", "leak_queries", "encoding_queries"]


def modules() -> list:
    return [importlib.import_module(f"{__package__}.{n}") for n in NAMES]
