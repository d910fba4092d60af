"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """``source``: a folder with ``log`` (JSON files of log messages), ``publication.json`` (publication, schema, table, pk) and a Parquet
    snapshot ``snapshot/<schema>.<table>`` of each table; ``snapshot_position`` is the log's position that it was taken at. ``topic``: the folder
    of events between reader and writer. ``destination``: keyed tables."""

    source: str = "source"
    destination: str = "destination"
    topic: str = "changes"
    publication: str = "all_tables"
    checkpoint: str = "checkpoints"
    snapshot_position: int = -1
    batch_files: int = 1
    buckets: int = 32
    trigger: str = "2 seconds"

    @classmethod
    def load(cls, prefix: str = "MILLRACE_") -> EngineConfig:
        base = cls()
        return cls(**{k: type(getattr(base, k))(os.environ.get(prefix + k.upper(), getattr(base, k))) for k in cls.__dataclass_fields__})
