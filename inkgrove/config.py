"""All knobs of the engine in one frozen dataclass."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

# The status vocabulary, in natural order.
STATUS_VALUES = ("draft", "active", "blocked", "approved", "verified", "completed", "falsified", "superseded", "archived")


@dataclass(frozen=True)
class EngineConfig:

    chunk_limit: int = 1500
    min_chunk_chars: int = 30
    sequence_cap: int = 1024
    embed_batch: int = 8
    max_file_bytes: int = 524_288
    max_line_chars: int = 10_000
    per_note: int = 2
    min_score: float | None = None
    rerank_chars: int = 600
    rerank_pool: int = 8
    read_page: int = 8000
    rrf_k: int = 60
    weights: tuple[float, float, float, float] = (2.0, 3.0, 0.2, 1.0)
    status_values: tuple[str, ...] = STATUS_VALUES
    embedding_dim: int = 1024
    model_name: str = "bag-of-words"

    def fingerprint(self, ignore: list[str] | None = None) -> str:
        """16 hex digits over everything that changes what the index holds."""
        facts = {
            "chunk": self.chunk_limit, "max_bytes": self.max_file_bytes, "max_line": self.max_line_chars,
            "ignore": sorted(ignore or []), "model": self.model_name, "seq": self.sequence_cap,
        }
        return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()[:16]
