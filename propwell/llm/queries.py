"""Every query of this subpackage."""

from propwell.llm import (  # noqa: F401
    chat_format,
    decontamination,
    exact_dedup,
    fill_middle,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
)
from propwell.llm.registry import ORACLE, QUERIES  # noqa: F401
