"""Versioned registries of operators and sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

API_VERSION = 1


@dataclass(frozen=True)
class Entry:
    name: str
    apply: Callable
    supports: Callable
    api_version: int


class Registry:
    """Names to DataFrame callables; a duplicate name or another API version is an error."""

    def __init__(self, kind: str):
        self.kind, self._entries = kind, {}

    def register(self, name: str, apply: Callable, *, supports: Callable = lambda *_, **__: True, api_version: int = API_VERSION) -> Entry:
        if api_version != API_VERSION:
            raise ValueError(f'{self.kind} "{name}" has API version {api_version}, expected {API_VERSION}')
        if name in self._entries:
            raise ValueError(f'{self.kind} "{name}" is already registered')
        self._entries[name] = entry = Entry(name, apply, supports, api_version)
        return entry

    def find(self, name: str) -> Entry | None:
        return self._entries.get(name)

    def get(self, name: str) -> Entry:
        if name not in self._entries:
            raise KeyError(f'{self.kind} "{name}" is not registered')
        return self._entries[name]

    def unregister(self, name: str) -> None:
        del self._entries[self.get(name).name]

    def apply(self, name: str, *inputs, **options):
        """Runs an entry after asking it whether it supports the inputs and options."""
        entry = self.get(name)
        if not entry.supports(*inputs, **options):
            raise ValueError(f'{self.kind} "{name}" does not support this input')
        return entry.apply(*inputs, **options)

    def names(self) -> list[str]:
        return sorted(self._entries)


operators, sources = Registry("operator"), Registry("source")
