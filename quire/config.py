"""Settings and fixed values of the retrieval engine."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    weight_vector: float = 0.70
    weight_phash: float = 0.10
    weight_text: float = 0.20
    similarity_threshold: float = 0.30
    phash_threshold: int = 12
    default_top_k: int = 20
    phash_candidates: int = 2000
    text_candidates: int = 500
    min_text_chars: int = 4
    min_segment_chars: int = 3
    max_segments: int = 16
    center_crop: bool = True
    crop_fraction: float = 0.7
    max_query_pixels: int = 60_000_000
    query_long_edge: int = 1600
    crash_limit: int = 2
    settle_seconds: int = 3
    settle_min_bytes: int = 1024
    settle_retries: int = 20
    rescan_seconds: int = 1800
    max_scan_depth: int = 3
    ocr_batch: int = 200
    upload_limit: int = 64 * 1024 * 1024
    worker_threads: int = 8
    batch_size: int = 32

    def __post_init__(self):
        if self.worker_threads < 1:
            raise ValueError("worker_threads must be at least 1")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")

    @property
    def scan_depth(self) -> int:
        return min(self.max_scan_depth, 32)

    def ann_candidates(self, top_k: int | None = None) -> int:
        return max(25 * (top_k or self.default_top_k), 500)


def load(path: str | None = None) -> Settings:
    """Settings from a TOML file (its tables are flattened; unknown keys are ignored); defaults where it is missing."""
    if path is None or not Path(path).exists():
        return Settings()
    known = {f.name for f in fields(Settings)}
    found: dict = {}
    for key, value in tomllib.loads(Path(path).read_text()).items():
        found |= value if isinstance(value, dict) else {key: value}
    return Settings(**{k: v for k, v in found.items() if k in known})
