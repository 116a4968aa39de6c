"""Settings of a run, from the environment or given directly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# What turns a setting that is on by default off, and one that is off by default on.
OFF, ON = frozenset(("0", "false", "no", "off")), frozenset(("1", "true", "yes", "on"))
PREFIX = "SHELFMARK_"


@dataclass(frozen=True)
class Config:
    """``root``: folder of the collection; ``base``: folder of the registry's tables."""

    root: str
    base: str = "./registry"
    digital_chars: int = 100
    digital_pages: int = 3
    normalise_names: bool = True
    online: bool = False
    model_key: str | None = field(default=None, repr=False)
    model: str | None = None
    most_toc: int = 30
    partition_seed: str = "shelfmark-partition-v1"
    partition_chunk: int = 50
    tree_root: str = "Root"
    exclude_keywords: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """Settings called ``SHELFMARK_<NAME>``; an error if the root is missing."""
        env = os.environ if env is None else env
        given: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None:
                continue
            low = raw.strip().lower()
            if f.type == "bool":
                given[f.name] = low not in OFF if f.default else low in ON
            elif f.type == "int":
                given[f.name] = int(raw)
            elif f.name == "exclude_keywords":
                given[f.name] = tuple(k for x in raw.split(",") if (k := x.strip()))
            else:
                given[f.name] = raw
        if not given.get("root"):
            raise ValueError(f"{PREFIX}ROOT is required")
        return cls(**given)  # type: ignore[arg-type]

    def require_online(self) -> None:
        """Error unless requests to a model are allowed and a key is there."""
        if not self.online:
            raise RuntimeError("requests to a model are switched off")
        if not self.model_key:
            raise RuntimeError("no key for the model")


def merge_keywords(config: Config, given: list[str] | None = None) -> list[str]:
    """Given keywords if there are any, else the configured ones: trimmed, non-blank, first spelling of each."""
    out: dict[str, str] = {}
    for k in given or config.exclude_keywords:
        if k.strip():
            out.setdefault(k.strip().lower(), k.strip())
    return list(out.values())
