"""Settings from the environment, with the coercions that tell a number or a flag from anything else."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields


def whole(text: str | None, default: int) -> int:
    """The whole number that ``text`` begins with, else ``default``."""
    hit = re.match(r"\s*([+-]?\d+)", text) if text else None
    return int(hit.group(1)) if hit else default


def flag(text: str | None, default: bool) -> bool:
    """True for 'true' and '1' in any case, false for other text, ``default`` where unset."""
    return default if text is None else text.strip().lower() in ("true", "1")


@dataclass(frozen=True)
class Settings:
    """Limits and defaults of the tools; each is read from its name in upper case."""

    log_level: str = "info"
    search_locale: str = "en"
    search_region: str = "us"
    max_results: int = 10
    default_timeout_ms: int = 15_000
    default_settle_ms: int = 1200
    browser_concurrency: int = 2
    resource_block_images: bool = True
    resource_block_media: bool = True
    resource_block_fonts: bool = True

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            values[f.name] = flag(raw, f.default) if isinstance(f.default, bool) else whole(raw, f.default) if isinstance(f.default, int) else (raw or f.default)
        return cls(**values)
