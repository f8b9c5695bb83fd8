"""Settings, read once from the environment and handed to what needs them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    strategy: str = "fast"
    vlm_routes_file: str = ""
    vlm_model_override: str = ""
    vlm_concurrency: int = 10
    vlm_timeout: int = 60
    enrich_links: bool = False
    extract_images: bool = False
    page_tags: bool = False
    image_dpi: int = 200
    image_max_size: int = 4096
    output_dir: str = "output"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefixes: tuple[str, ...] = ("PAGEMILL_", "FPE_")) -> Settings:
        """Fields that the environment sets, under our prefix or, for configurations that are already there, the older one; ours counts first.
        Unknown variables are ignored, a value of the wrong kind is an error."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = next((env[k] for p in prefixes if (k := f"{p}{f.name.upper()}") in env), None)
            if raw is not None:
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return replace(cls(), **given)
