"""Settings of the commands: an optional folioscope.yaml of flat sections, environment, defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path


@dataclass
class Config:
    answer_provider: str = "extractive"
    endpoint: str | None = None
    model: str | None = None
    api_key: str | None = None
    timeout: float = 30
    embedding: str = "none"


def parse(text: str) -> dict[str, str]:
    """``section: / key: value`` as ``section.key``; anything deeper is an error."""
    out, section = {}, ""
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"(\s*)([A-Za-z_][\w-]*):\s*(.*?)\s*", line)
        if not m:
            raise ValueError(f"folioscope.yaml, line {n}: not a setting")
        if not m[1]:
            section = m[2]
        value = m[3].strip("\"'")
        if value:
            out[f"{section}.{m[2]}" if m[1] else m[2]] = value
    return out


def load(path: str | None = None) -> Config:
    """A missing file gives the defaults; the environment fills what the file leaves open."""
    file = Path(path or "folioscope.yaml")
    found = parse(file.read_text(encoding="utf-8")) if file.exists() else {}
    get = lambda key, env=None: found.get(f"ask.{key}") or (os.environ.get(env) if env else None)
    return Config(get("provider") or "extractive", get("endpoint", "OPENAI_BASE_URL"), get("model", "OPENAI_MODEL"), get("api_key", "OPENAI_API_KEY"), float(get("timeout") or 30), found.get("rag.embedding", "none"))
