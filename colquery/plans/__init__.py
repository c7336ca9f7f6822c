"""Plan counters, engine switches and the registries of operators and sources, filled by ``colquery.builtin``."""

from .config import EngineConfig
from .counters import plan_counters
from .registry import API_VERSION, Registry, operators, sources

__all__ = ["API_VERSION", "EngineConfig", "Registry", "operators", "plan_counters", "sources"]
