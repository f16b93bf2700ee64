"""Settings from the environment: typed, with defaults, checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# The default instruction, the modes, and below the names and defaults of the settings.
INSTRUCTION = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
EXPOSE_MODES = ("off", "cloudflare-quick")


@dataclass(frozen=True)
class Settings:
    worker_count: int = 2
    embedding_dimensions: int = 4096
    max_batch_items: int = 16
    max_batch_estimated_tokens: int = 512
    max_queue_estimated_tokens: int = 32_768
    max_request_items: int = 128
    max_request_body_bytes: int = 2_000_000
    max_text_characters: int = 32_768
    max_sequence_tokens: int = 4096
    query_instruction: str = INSTRUCTION
    api_key: str | None = None
    expose_mode: str = "off"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        given = {f.name: env[f.name.upper()] for f in fields(cls) if f.name.upper() in env}
        values = {k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()}
        values["api_key"] = values.get("api_key") or None
        values["expose_mode"] = values.get("expose_mode", "off").strip() or "off"
        if values["expose_mode"] not in EXPOSE_MODES:
            raise ValueError(f"EXPOSE_MODE must be one of {EXPOSE_MODES}")
        if values["expose_mode"] != "off" and values["api_key"] is None:
            raise ValueError("API_KEY is required to expose the service")
        return cls(**values)
