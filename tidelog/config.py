"""Engine settings: a flat JSON file over defaults, with validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    # The store's documented defaults.
    memtable_size: int = 10
    memtable_instances: int = 2
    max_levels: int = 4
    max_bytes: int = 5000
    max_tables: int = 2
    scaling_factor: int = 2
    compaction_algorithm: str = "sizeTiered"
    compaction_condition: str = "tables"
    bloom_expected: int = 1000
    bloom_fpp: float = 0.001
    cms_epsilon: float = 0.001
    cms_delta: float = 0.001
    hll_precision: int = 8
    hll_64bit: bool = False
    cache_capacity: int = 100
    token_number: int = 20
    token_refresh_seconds: int = 2
    wal_segment_records: int = 2
    wal_segment_bytes: int = 200
    wal_low_water: int = 2
    block_records: int = 2
    summary_blocks: int = 2
    leveled_base_bytes: int = 3000
    leveled_run_bytes: int = 1500

    def valid(self) -> EngineConfig:
        """The settings with every value that can't be used replaced by its default."""
        base, fixed = EngineConfig(), {}
        for f in fields(self):
            value, usual = getattr(self, f.name), getattr(base, f.name)
            if isinstance(usual, bool) or isinstance(usual, str):
                ok = isinstance(value, type(usual))
            else:
                ok = isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0
            fixed[f.name] = value if ok else usual
        if not 4 <= fixed["hll_precision"] <= 16:
            fixed["hll_precision"] = base.hll_precision
        if fixed["compaction_algorithm"] not in ("sizeTiered", "leveled"):
            fixed["compaction_algorithm"] = base.compaction_algorithm
        if fixed["compaction_condition"] not in ("tables", "bytes"):
            fixed["compaction_condition"] = base.compaction_condition
        return EngineConfig(**fixed)


def load(path: str) -> EngineConfig:
    """Reads settings; what is missing (or the file) has its default."""
    p = Path(path)
    if not p.exists():
        return EngineConfig()
    names = {f.name for f in fields(EngineConfig)}
    return EngineConfig(**{k: v for k, v in json.loads(p.read_text()).items() if k in names}).valid()


def save(config: EngineConfig, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(config), indent=1))
