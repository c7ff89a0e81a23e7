"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP7_SQL, op7_chat
from .context_mixing import op8_context_mixing
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard import OP4_SQL, op4_jaccard
from .media import op10_media
from .mixing import OP6_SQL, op6_mixing
from .packing import op1_packing
from .secrets import op3_secrets
from .shards import op2_token_shards
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_shards": op2_token_shards,
        "op3_secrets": op3_secrets,
        "op4_jaccard": op4_jaccard,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_chat": op7_chat,
        "op8_context_mixing": op8_context_mixing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op6_mixing": OP6_SQL, "op7_chat": OP7_SQL, "op9_exact_dedup": OP9_SQL}
