"""Settings, templates and small plain-Python helpers of an ingest."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.media import BATCH_SIZES, MAX_INLINE_BYTES


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    value = env.get(name, "").strip().lower()
    return value in ("1", "true", "yes", "on") if value else default


def required(env: Mapping[str, str], name: str) -> str:
    """A setting that must be there; fails at once where it is not."""
    if not (value := env.get(name, "").strip()):
        raise ValueError(f"{name} is not set")
    return value


@dataclass(frozen=True)
class IngestConfig:
    """Ingest settings; a known rigor gives the number of descriptions in a request."""

    update_mode: bool = False
    dummy_descriptions: bool = False
    rigor: str = "very low"
    max_inline_bytes: int = MAX_INLINE_BYTES
    max_width: int = 1600
    max_height: int = 1600
    flush_at: int = 128

    @property
    def batch_size(self) -> int:
        return BATCH_SIZES.get(self.rigor.strip().lower(), BATCH_SIZES["very low"])

    @classmethod
    def from_env(cls, prefix: str, env: Mapping[str, str] | None = None) -> IngestConfig:
        env = os.environ if env is None else env
        number = lambda name, default: int(env.get(prefix + name, "").strip() or default)
        return cls(
            flag(env, prefix + "UPDATE"), flag(env, prefix + "DUMMY"), env.get(prefix + "RIGOR", "").strip().lower() or cls.rigor,
            number("MAX_INLINE_BYTES", cls.max_inline_bytes), number("MAX_WIDTH", cls.max_width), number("MAX_HEIGHT", cls.max_height), number("FLUSH_AT", cls.flush_at),
        )

    def can_describe(self, client: object) -> bool:
        return self.dummy_descriptions or client is not None


def render(template: str, values: Mapping[str, str]) -> str:
    """The template with __name__ replaced by its value."""
    for name, value in values.items():
        template = template.replace(f"__{name}__", value)
    return template


def prompt_sections(folder: str, batch_size: int) -> dict[str, str]:
    """The templates admin, prompt and item of a folder, with __batch_size__ filled in; those that are not there are left out."""
    found = {name: os.path.join(folder, f"{name}.md") for name in ("admin", "prompt", "item")}
    return {name: render(Path(path).read_text(), {"batch_size": str(batch_size)}) for name, path in found.items() if os.path.isfile(path)}


def history_user(env: Mapping[str, str] | None = None) -> str:
    """Whose searches are kept."""
    return (os.environ if env is None else env).get("MEDIA_SEARCH_HISTORY_USER", "local")


def merge(old: dict, new: dict) -> dict:
    """Dictionaries merge key by key, lists follow one another, anything else is the new one's."""
    out = dict(old)
    for key, value in new.items():
        have = out.get(key)
        if isinstance(have, dict) and isinstance(value, dict):
            out[key] = merge(have, value)
        elif isinstance(have, list) and isinstance(value, list):
            out[key] = have + value
        else:
            out[key] = value
    return out


def decode(raw: bytes) -> str:
    """Text of embedded bytes: UTF-8, or UTF-16 where zero bytes speak for it, else Latin-1; without zeros at the end."""
    for name in ("utf-16", "utf-8") if b"\x00" in raw.rstrip(b"\x00") else ("utf-8", "utf-16"):
        try:
            return raw.decode(name).rstrip("\x00")
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1").rstrip("\x00")


def embedding_chunk(n: int, processes: int, chosen: int | None = None) -> int:
    """Documents in a call of an embedder, so that each of the processes gets two calls or more."""
    return chosen or max(1, -(-n // (2 * max(processes, 1))))


@dataclass
class Timings:
    """Seconds of the named steps of a run."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
