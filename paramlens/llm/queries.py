"""The operators applied to whole tables, by query name."""

from __future__ import annotations

import importlib

from .common import table
from .sql import ORACLE

#: Query, module and table.
_OPERATORS = {
    "op1_url_filter": ("url_filter", "pages"),
    "op2_pii": ("pii", "documents"),
    "op3_quality": ("quality", "documents"),
    "op5_substring": ("substring", "documents"),
    "op6_secrets": ("secrets", "documents"),
    "op8_mixing": ("mixing", "documents"),
    "op9_itq": ("itq", "embeddings"),
    "op10_minmax": ("minmax", "documents"),
    "op12_periods": ("periods", "documents"),
    "op13_repair": ("repair", "conversations"),
}


def _query(module: str, name: str):
    rows = importlib.import_module(f"{__package__}.{module}").digest_row

    def run(spark, sf_dir):
        return rows(table(spark, sf_dir, name))

    return run


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import digest_row

    return digest_row(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark, sf_dir):
    from .toxicity import digest_row

    return digest_row(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_passages(spark, sf_dir):
    from .passages import digest_row

    return digest_row(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    simple = {name: _query(*where) for name, where in _OPERATORS.items()}
    return simple | {"op4_bpe": op4_bpe, "op7_toxicity": op7_toxicity, "op11_passages": op11_passages}


def oracle_sql():
    """SQL where it can express an operator; the others are tested against brute force."""
    return dict(ORACLE)
