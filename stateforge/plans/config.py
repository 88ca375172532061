"""Configurations: nested dicts from YAML or JSON files that may name defaults to build on."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def _load(path: Path) -> dict[str, Any]:
    content = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(content)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configurations need the yaml package; JSON ones don't") from e
    return yaml.safe_load(content) or {}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """`over` on `base`: dicts merge, everything else (lists too) is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A configuration on top of its `defaults` (one or a list, relative to the file, each on top of its own)."""
    p = Path(path).resolve()
    if str(p) in seen:
        raise ValueError(f"configuration defaults go in a circle: {p}")
    own = _load(p)
    names = own.pop("defaults", [])
    out: dict[str, Any] = {}
    for name in [names] if isinstance(names, str) else names:
        out = merged(out, load(str(p.parent / name), (*seen, str(p))))
    return checked(merged(out, own)) if not seen else merged(out, own)


def checked(config: dict[str, Any]) -> dict[str, Any]:
    """One seed throughout, and room for a prompt beside the new tokens."""
    seed = config.get("project", {}).get("seed")
    for part in ("rollout", "training", "evaluation"):
        other = config.get(part, {}).get("seed", seed)
        if seed is not None and other != seed:
            raise ValueError(f"{part}.seed {other} differs from project.seed {seed}")
    made = config.get("rollout", {}).get("generation", {})
    if made.get("max_model_length") and made.get("max_new_tokens", 0) >= made["max_model_length"]:
        raise ValueError("max_new_tokens must be smaller than max_model_length")
    return config
