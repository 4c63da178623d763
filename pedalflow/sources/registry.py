"""The providers to collect from, as configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from .feeds import REQUIRED


@dataclass(frozen=True)
class Provider:
    """A name, the address of its discovery document and the feeds that are collected."""

    name: str
    discovery: str
    feeds: tuple[str, ...] = REQUIRED


def providers(env: Mapping[str, str]) -> dict[str, Provider]:
    """Those of PEDALFLOW_PROVIDERS, a JSON object of name to address, or to an object with ``url``, ``feeds`` and
    ``enabled``. Names must be usable as folders."""
    found = {}
    for name, entry in json.loads(env.get("PEDALFLOW_PROVIDERS") or "{}").items():
        entry = {"url": entry} if isinstance(entry, str) else entry
        if not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"no usable provider name: {name!r}")
        lacking = set(entry.get("feeds", REQUIRED)) - set(REQUIRED)
        if lacking:
            raise ValueError(f"unknown feeds of {name}: {', '.join(sorted(lacking))}")
        if entry.get("enabled", True):
            found[name] = Provider(name, entry["url"], tuple(entry.get("feeds", REQUIRED)))
    return found
