"""Parameters of training, index and search."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    dims: int = 14
    k: int = 4096
    nprobe_fast: int = 10
    nprobe_full: int = 16
    neighbors: int = 5
    band: tuple[int, int] = (2, 3)
    threshold: int = 3
    iterations: int = 25
    sample: int = 262_144
    seed: int = 0xDEADBEEFCAFEBABE
    block_width: int = 8
    scale: int = 10_000
    ties: str = "stable"  # or "slot"
    metric: str = "int"  # or "f32"
    warmup_rounds: int = 16

    def __post_init__(self):
        if not 1 <= self.k <= 4096:
            raise ValueError("k must be 1 to 4096")
        if not 1 <= self.nprobe_fast <= self.nprobe_full:
            raise ValueError("nprobe_fast must be 1 to nprobe_full")
        if self.sample < self.k:
            raise ValueError("the sample must hold k vectors at least")
        if self.ties not in ("stable", "slot") or self.metric not in ("int", "f32"):
            raise ValueError("ties is stable or slot, metric is int or f32")

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, **fields) -> EngineConfig:
        """fields with what the environment says: WARMUP_ROUNDS, a number of 0 or more, rounded down; any other text is passed over."""
        config, text = cls(**fields), (os.environ if environ is None else environ).get("WARMUP_ROUNDS", "")
        try:
            rounds = float(text)
        except ValueError:
            return config
        return replace(config, warmup_rounds=math.floor(rounds)) if math.isfinite(rounds) and rounds >= 0 else config
