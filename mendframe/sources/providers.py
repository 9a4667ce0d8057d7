"""Providers: what stands for a model.  ``infer`` maps prompts to outputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol


class Provider(Protocol):
    def infer(self, prompts: Sequence[str]) -> list[str]: ...


@dataclass(frozen=True)
class Static:
    """Fixed outputs: none gives '', one repeats, fewer than prompts repeat the last."""

    outputs: tuple[str, ...] = ()

    def infer(self, prompts: Sequence[str]) -> list[str]:
        known = list(self.outputs) or [""]
        return [known[min(k, len(known) - 1)] for k in range(len(prompts))]


@dataclass(frozen=True)
class Calling:
    """A function of one prompt."""

    fn: Callable[[str], str]

    def infer(self, prompts: Sequence[str]) -> list[str]:
        return [self.fn(p) for p in prompts]


@dataclass
class Registry:
    """Providers by a pattern of the model's name; the highest priority wins."""

    entries: list[tuple[int, str, Callable[[], Provider]]] = field(default_factory=list)

    def register(self, pattern: str, make: Callable[[], Provider], priority: int = 0) -> None:
        self.entries.append((priority, pattern, make))

    def resolve(self, model: str) -> Provider:
        for _, pattern, make in sorted(self.entries, key=lambda e: -e[0]):
            if re.search(pattern, model):
                return make()
        raise KeyError(f"no provider for {model!r}")

    def by_class(self, name: str) -> Provider:
        """The provider whose class's name holds ``name``, in any case."""
        for _, _, make in sorted(self.entries, key=lambda e: -e[0]):
            made = make()
            if name.lower() in type(made).__name__.lower():
                return made
        raise KeyError(f"no provider class {name!r}")
