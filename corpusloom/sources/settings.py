"""Settings and prompt templates: plain values on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """What the plans take from a configuration; environment variables win."""

    chunk_size: int = 512
    min_chunk_size: int = 150
    top_k: int = 50
    rerank_k: int = 5
    cache_similarity: float = 0.85
    vector_size: int = 64
    distance: str = "cosine"

    @classmethod
    def load(cls, values: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None) -> Settings:
        """Known keys of ``values``, then CORPUSLOOM_<KEY> from the environment.  Unknown keys
        are ignored; a distance that is not known is a ValueError."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        out = replace(cls(), **{k: kinds[k](v) for k, v in (values or {}).items() if k in kinds})
        env = os.environ if env is None else env
        out = replace(out, **{k: kind(env[name]) for k, kind in kinds.items() if (name := f"CORPUSLOOM_{k.upper()}") in env})
        if out.distance not in ("cosine", "dot", "euclid"):
            raise ValueError(f"unknown distance: {out.distance}")
        return out


def from_yaml(path: str, env: Mapping[str, str] | None = None) -> Settings:
    """Settings of a YAML file, top-level keys or those of a section; a missing file gives the
    defaults.  Needs a YAML reader."""
    import yaml

    if not os.path.exists(path):
        return Settings.load({}, env)
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f) or {}
    flat = {k: v for part in tree.values() if isinstance(part, dict) for k, v in part.items()}
    return Settings.load(flat | {k: v for k, v in tree.items() if not isinstance(v, dict)}, env)


#: Prompt templates by version.
PROMPTS: dict[str, dict[str, str]] = {
    "v1": {
        "system": "Answer from the retrieved context only.",
        "cite": "Name the numbers of the passages that you used.",
        "rate": "Say how sure you are: high, medium, low or insufficient.",
    },
}


def prompts(version: str = "v1") -> dict[str, str]:
    """The templates of a version, those of the first one where it is missing."""
    return PROMPTS.get(version, PROMPTS["v1"])
