"""Settings, read once at the driver from a mapping (an environment or session options) and never a column."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def _number(kind: type, least: float | None = None) -> Callable[[str], Any]:
    def read(value: str):
        made = kind(value)
        if least is not None and made < least:
            raise ValueError(f"must be at least {least}")
        return made

    return read


def _flag(value: str) -> bool:
    v = value.strip().lower()
    if v in _TRUE or v in _FALSE:
        return v in _TRUE
    raise ValueError("must be a boolean")


def _one_of(*names: str) -> Callable[[str], str]:
    def read(value: str) -> str:
        v = value.strip().lower()
        if v not in names:
            raise ValueError(f"must be one of {', '.join(names)}")
        return v

    return read


@dataclass(frozen=True)
class EngineConfig:
    """Limits, routing thresholds and modes. The numbers are the defaults users of such a converter know."""

    max_pages: int = 200
    max_upload_bytes: int = 100 * 1024 * 1024
    page_concurrency: int = 2
    max_concurrency: int = 1
    base_url: str = "http://127.0.0.1:8080"
    model: str = "ocr"
    request_timeout_seconds: int = 600
    max_tokens: int = 8192
    render_dpi: int = 220
    render_max_edge: int = 1280
    fast_pass: bool = True
    fast_render_dpi: int = 200
    fast_render_max_edge: int = 1100
    fast_non_table_max_edge: int = 960
    fast_max_tokens_text: int = 4096
    fast_max_tokens_table: int = 8192
    fast_retry: bool = False
    retry_min_quality: float = 0.40
    retry_quality_gap: float = 0.22
    retry_min_layer_length: int = 80
    table_threshold: float = 0.60
    merge_policy: str = "strict"
    postprocess_mode: str = "light"
    layer_fallback_mode: str = "repeat"
    secondary_table_repair: bool = True
    footer: str | None = None

    @classmethod
    def read(cls, source: Mapping[str, str] | None = None, prefix: str = "QUIRE_") -> EngineConfig:
        """From entries named by prefix and the field in capitals; unset or blank ones keep their default, bad ones are errors."""
        source = os.environ if source is None else source
        out = {}
        for f in fields(cls):
            raw = (source.get(prefix + f.name.upper()) or "").strip()
            if not raw:
                continue
            try:
                out[f.name] = _READERS.get(f.name, _BY_TYPE[type(f.default)])(raw)
            except ValueError as e:
                raise ValueError(f"{prefix}{f.name.upper()}={raw!r}: {e}") from e
        return cls(**out)


_BY_TYPE: dict[type, Callable[[str], Any]] = {bool: _flag, int: _number(int, 1), float: _number(float, 0.0), str: str, type(None): str}
_READERS: dict[str, Callable[[str], Any]] = {
    "merge_policy": _one_of("strict", "aggressive"),
    "postprocess_mode": _one_of("full", "light", "off"),
    "layer_fallback_mode": _one_of("off", "repeat", "aggressive"),
    "fast_non_table_max_edge": _number(int, 0),
    "retry_min_layer_length": _number(int, 0),
}
