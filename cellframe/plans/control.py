"""Driver-side values of a run: steps, file names, counters, parameters asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace


def before_timestep(timestep: int, end_at: int) -> bool:
    """True up to and at the end."""
    return timestep <= end_at


def timestep_file(fmt: str, timestep: int) -> str:
    """A printf format filled with the step."""
    return fmt % timestep


def value_scale(value: float, scale: float = 1.0) -> float:
    return value * scale


def ask(kind: type, given: dict, name: str, default=None):
    """A parameter by name; nothing is read from a terminal, as jobs run unattended."""
    return kind(given[name]) if name in given else default


@dataclass(frozen=True)
class Events:
    """How often the balance, the lists and the domain changed, and the greatest imbalance seen."""

    balances: int = 0
    moves: int = 0
    extensions: int = 0
    imbalance_max: float = 0.0

    def seen(self, balanced: bool = False, moved: bool = False, extended: bool = False, imbalance: float = 0.0) -> Events:
        return replace(self, balances=self.balances + balanced, moves=self.moves + moved, extensions=self.extensions + extended, imbalance_max=max(self.imbalance_max, imbalance))
