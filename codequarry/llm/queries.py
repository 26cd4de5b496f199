"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from ..session import ship_package
from . import (bpe, chat, embedding_dedup, exact_dedup, merkle, mixing, near_dedup, periodic, pii, quality, sharding,
               token_counts, toxicity)


def _shipped(fn):
    """Run ``fn`` with the package importable in Python workers."""
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {
    "op1_toxicity": _shipped(toxicity.op1),
    "op2_near_dedup": _shipped(near_dedup.op2),
    "op3_quality": _shipped(quality.op3),
    "op4_reshard": _shipped(sharding.op4),
    "op5_chat": _shipped(chat.op5),
    "op6_embedding_dedup": _shipped(embedding_dedup.op6),
    "op7_mix": mixing.op7,
    "op8_pii": pii.op8,
    "op9_bpe": _shipped(bpe.op9),
    "op10_exact_dedup": exact_dedup.op10,
    "op11_token_counts": _shipped(token_counts.op11),
    "op12_periodic_runs": _shipped(periodic.op12),
    "op13_merkle": merkle.op13,
}

ORACLE = {
    "op7_mix": mixing.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
