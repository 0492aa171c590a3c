"""Settings: typed defaults, overridden by environment variables.

A variable is the setting's name in upper case (``CHUNK_SIZE=256``).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    #: Names that benchmark records carry; the models themselves are functions.
    llm_provider: str = "extractive"
    llm_model_name: str = "extractive"
    embedding_provider: str = "hashing"
    embedding_model_name: str = "hashing-256"
    embedding_dim: int = 256
    #: Folders that the command line uses where none is given.
    workspace_dir: str = "data/workspace"
    raw_data_dir: str = "data/raw"
    processed_data_dir: str = "data/processed"
    results_dir: str = "results"
    tokenizer_dir: str = "/opt/tokenizers"
    tokenizer_vocabulary: str = "byte_bpe_50k.tiktoken"
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k: int = 5
    expansion_hops: int = 1
    #: Context window of the extraction model, in tokens.
    extraction_num_ctx: int = 2048
    #: Largest side of a join, in bytes, that may be sent to every task.
    broadcast_bytes: int = 32 * 1024 * 1024

    def __post_init__(self):
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be at least 0 and below the chunk size")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    given = {}
    for f in fields(Settings):
        raw = os.environ.get(f.name.upper())
        if raw is not None:
            given[f.name] = int(raw) if f.type == "int" else raw
    return Settings(**given)
