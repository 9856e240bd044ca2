"""Settings that are part of the semantics; durations in microseconds. Production and demo values."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

SECOND = 1_000_000
HOUR = 3600 * SECOND


@dataclass(frozen=True)
class Config:
    """``tick`` divides every window, so that windows are whole numbers of decision ticks."""

    tick: int = SECOND
    signal_tick: int = 5 * SECOND
    windows: tuple[int, ...] = (5 * SECOND, 15 * SECOND, 60 * SECOND)
    lookback: int = 1800 * SECOND
    breakout: int = 180 * SECOND
    atr_period: int = 60 * SECOND
    atr_bar: int = SECOND
    retention: int = 86_400 * SECOND
    capacity: int = 500_000
    lateness: int = 250_000
    oi_stale_after: int = 15 * SECOND
    cross_max_age: int = 2 * SECOND
    cross_max_difference: int = 500_000
    cross_min_samples: int = 30
    epsilon: float = 1e-12
    tolerance: float = 0.25
    jump_z: float = 4.0
    large_trade: float = 100_000.0
    walk_notional: float = 10_000.0
    depth: int = 5
    depth_weights: tuple[float, ...] = (1.0, 0.8, 0.6, 0.4, 0.2)
    dedup_ttl: int = 300 * SECOND
    dedup_capacity: int = 10_000
    blocked_statuses: tuple[str, ...] = ("STALE", "RESYNCING", "DISCONNECTED")

    def __post_init__(self) -> None:
        if self.tick <= 0 or any(w <= 0 or w % self.tick for w in (*self.windows, self.lookback, self.breakout, self.atr_period)):
            raise ValueError("windows must be positive multiples of the tick")

    def ticks(self, duration: int) -> int:
        return duration // self.tick


#: The driver's event table holds one event in some minutes, so the demo runs in hours.
DEMO = Config(
    tick=HOUR,
    signal_tick=5 * HOUR,
    windows=(HOUR, 6 * HOUR, 24 * HOUR),
    lookback=168 * HOUR,
    breakout=12 * HOUR,
    atr_period=24 * HOUR,
    atr_bar=600 * SECOND,
    retention=720 * HOUR,
    lateness=600 * SECOND,
    oi_stale_after=6 * HOUR,
    cross_max_age=2 * HOUR,
    cross_max_difference=HOUR,
    large_trade=200.0,
    walk_notional=20_000.0,
)


def load(path: str | None = None, environ: dict[str, str] | None = None, base: Config | None = None) -> Config:
    """Settings from a JSON file over the defaults, then TICKFRAME_<NAME> variables (JSON values) over both."""
    known = {f.name for f in fields(Config)}
    given: dict = {}
    if path is not None:
        with open(path) as f:
            given |= json.load(f)
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith("TICKFRAME_"):
            given[name.removeprefix("TICKFRAME_").lower()] = json.loads(value)
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(base or Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def fingerprint(config: Config) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()


def source_hash(root: str | None = None) -> str:
    """SHA-256 over the names and contents of the package's Python files, in order of name."""
    import hashlib
    from pathlib import Path

    folder, h = Path(root or Path(__file__).parent), hashlib.sha256()
    for f in sorted(folder.rglob("*.py")):
        body = f.read_bytes()
        h.update(f"{f.relative_to(folder).as_posix()}\0{len(body)}\0".encode() + body)
    return h.hexdigest()
