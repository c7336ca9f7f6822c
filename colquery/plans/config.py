"""Engine switches by name; ``equi_join``, ``read_snapshot``, ``read_table`` and ``read_arrow`` take them as ``config``."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    enable: bool = True
    enable_hash_join: bool = True  # off: equi-joins are asked to merge
    snapshot_enable: bool = True
    snapshot_mode: str = "filter"  # batch, prune or filter
    arrow_pushdown: bool = True
    arrow_column_pruning: bool = True

    def __post_init__(self):
        if self.snapshot_mode not in ("batch", "prune", "filter"):
            raise ValueError(f"unknown snapshot mode {self.snapshot_mode}")

    def set(self, **switches) -> EngineConfig:
        return replace(self, **switches)

    @property
    def join_strategy(self) -> str | None:
        return None if self.enable and self.enable_hash_join else "merge"
