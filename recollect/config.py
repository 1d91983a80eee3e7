"""Settings of the engine: weights, thresholds, labels and the clock.  Fixed values are plain data here."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    now: str = "2024-02-01 00:00:00"
    #: Labels of actors; subjects are the actors and the group of all.
    owner: str = "user"
    assistants: tuple[str, ...] = ("assistant_a", "assistant_b", "assistant_c")
    group: str = "us"
    live: tuple[str, ...] = ("candidate", "confirmed")
    #: Half-lives of memory types, in days; others have `other_half_life`.
    half_lives: dict[str, float] = field(default_factory=lambda: {"preference": 365.0, "semantic": 240.0, "procedural": 120.0})
    other_half_life: float = 45.0
    cold_below: float = 0.55
    active_from: float = 0.75
    rrf_k: int = 60
    pin_bonus: float = 0.02
    confirmed_bonus: float = 0.012
    goal_weight: float = 0.03
    hint_bonus: float = 0.01
    echo_factor: float = 1 / 3
    cold_factor: float = 0.5
    stale_factor: float = 0.5
    summary_factor: float = 0.7
    per_term: int = 8
    vector_k: int = 8
    vector_floor: float = 0.55
    keep: int = 12
    too_common: int = 300
    votes: float = 3.0
    vote_days: int = 2
    near_duplicate: float = 0.65
    link: float = 0.75
    idle_minutes: int = 180
    cap_messages: int = 300
    cap_hours: int = 6
    settle_minutes: int = 5
    backoff_minutes: tuple[int, ...] = (10, 20, 40, 60, 60)
    #: Tries of what fails for good, and hours after its first failure in which something is tried at all.
    permanent_tries: int = 3
    dead_hours: float = 24
    chunk_chars: int = 6000
    #: How many open rows of each kind the working set holds.
    bounds: dict[str, int] = field(default_factory=lambda: {"goal": 3, "task": 7, "topic": 5, "state": 5, "emotion": 1})
    cooldown_minutes: int = 30
    bin_days: int = 15


    @classmethod
    def load(cls, path: str) -> Config:
        """The settings of a JSON file; what it doesn't name keeps its default, and a name that is none is an error."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if unknown := set(given) - {x.name for x in fields(cls)}:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


CONFIG = Config()


@dataclass(frozen=True)
class Switches:
    """Named switches of a deployment, from the environment or any mapping; on is 1, true, yes or on."""

    values: Mapping[str, str] = field(default_factory=lambda: os.environ)
    prefix: str = "RECOLLECT_"

    def raw(self, name: str, default: str = "") -> str:
        return self.values.get(self.prefix + name, default)

    def on(self, name: str, default: bool = False) -> bool:
        return self.raw(name, str(default)).strip().lower() in ("1", "true", "yes", "on")

    def require(self, name: str) -> str:
        if not (found := self.raw(name).strip()):
            raise KeyError(f"{self.prefix}{name} is not set")
        return found
