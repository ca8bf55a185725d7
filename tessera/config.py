"""Default parameters of the searches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    #: Query vectors that are sent to all tasks; larger sets are dealt in blocks, against blocks of rows.
    query_block: int = 2048
    row_block: int = 16384


DEFAULT = EngineConfig()
