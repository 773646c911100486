"""Configuration: a TOML file, required keys, and policies with overrides per message type. All problems are told at once."""

from __future__ import annotations

import dataclasses
import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.text import UNITS

#: The bounds on rows of one redrive.
MAX_REDRIVE_ROWS = 10_000
ABOVE_ZERO = "has to be above 0"


class ConfigErrors(ValueError):
    """Every problem of a configuration as (key, message)."""

    def __init__(self, issues: list[tuple[str, str]]):
        super().__init__("; ".join(f"{k}: {m}" for k, m in issues))
        self.issues = issues


def seconds(text: str) -> float:
    """Seconds of `250ms`, `30s`, `5m`, `1h`, `7d`."""
    m = re.fullmatch(r"\s*([0-9]+)(ms|s|m|h|d)\s*", text) if isinstance(text, str) else None
    if not m:
        raise ValueError("must be an unsigned integer with a unit of ms, s, m, h, d")
    millis = int(m[1]) * UNITS[m[2]]
    if millis >= 2**64:
        raise ValueError("is too long")
    return millis / 1000


# The defaults of all policies, here and below.
@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 10
    initial_backoff: float = 1.0
    max_backoff: float = 300.0
    multiplier: float = 2.0
    errors_limit: int = 20
    dlq: str = "table"

    def issues(self):
        if self.max_attempts < 1:
            yield "max_attempts", "must be 1 or more"
        if self.initial_backoff <= 0:
            yield "initial_backoff", ABOVE_ZERO
        if self.initial_backoff > self.max_backoff:
            yield "initial_backoff", "must not be above max_backoff"
        if not math.isfinite(self.multiplier) or self.multiplier < 1:
            yield "multiplier", "must be finite and 1.0 or more"
        if self.errors_limit < 1:
            yield "errors_limit", "must be 1 or more"
        if self.dlq != "table":
            yield "dlq", "must be table"


@dataclass(frozen=True)
class ObservabilityPolicy:
    """level, payload and headers are read and kept, and nothing depends on them yet."""

    level: str = "warn"
    lifecycle: str = "summary"
    payload: str = "off"
    headers: str = "managed-only"
    trace_handoff: str = "linked"
    sample_success: float = 0.0
    stuck_after: float = 60.0
    max_queue_age: float = 300.0

    def issues(self):
        if self.lifecycle not in ("summary", "per-message"):
            yield "lifecycle", "must be summary or per-message"
        if self.trace_handoff not in ("linked", "parented"):
            yield "trace_handoff", "must be linked or parented"
        if not 0 <= self.sample_success <= 1:
            yield "sample_success", "must be between 0 and 1"


@dataclass(frozen=True)
class Relay:
    batch_limit: int = 100
    lease_for: float = 30.0
    retry_after: float = 1.0
    poll_interval: float = 0.25

    def issues(self):
        yield from ((n, ABOVE_ZERO) for n in ("batch_limit", "lease_for", "poll_interval") if getattr(self, n) <= 0)


@dataclass(frozen=True)
class Dispatcher:
    poll_interval: float = 0.25
    max_consecutive_panicking_rows: int = 10

    def issues(self):
        yield from ((n, ABOVE_ZERO) for n in ("poll_interval", "max_consecutive_panicking_rows") if getattr(self, n) <= 0)


@dataclass(frozen=True)
class Purge:
    older_than: float = 604_800.0
    batch_size: int = 1000
    poll_interval: float = 60.0
    include_failed: bool = False

    def issues(self):
        yield from ((n, ABOVE_ZERO) for n in ("older_than", "batch_size", "poll_interval") if getattr(self, n) <= 0)


@dataclass(frozen=True)
class Recovery:
    batch_size: int = 100
    pause_ms: int = 0
    max_redrive_rows: int = 1000

    def issues(self):
        if self.batch_size <= 0:
            yield "batch_size", ABOVE_ZERO
        if self.pause_ms < 0:
            yield "pause_ms", "must not be negative"
        if not 1 <= self.max_redrive_rows <= MAX_REDRIVE_ROWS:
            yield "max_redrive_rows", f"must be between 1 and {MAX_REDRIVE_ROWS}"


SECTIONS = {"retry": RetryPolicy, "observability": ObservabilityPolicy, "relay": Relay, "dispatcher": Dispatcher, "purge": Purge, "recovery": Recovery}


def merged(base, values: dict, path: str, issues: list):
    """The policy with the values that are there, read by the type of the field; unknown or unreadable ones become issues."""
    kinds, good = {f.name: type(getattr(base, f.name)) for f in dataclasses.fields(base)}, {}
    for name, value in values.items():
        kind = kinds.get(name)
        if kind is None:
            issues.append((f"{path}.{name}", "unknown key"))
        elif kind is float and isinstance(value, str):
            try:
                good[name] = seconds(value)
            except ValueError as e:
                issues.append((f"{path}.{name}", str(e)))
        elif kind is float and isinstance(value, int) and not isinstance(value, bool):
            good[name] = float(value)
        elif type(value) is not kind:
            issues.append((f"{path}.{name}", f"must be {kind.__name__}"))
        else:
            good[name] = value
    out = dataclasses.replace(base, **good)
    issues += [(f"{path}.{n}", m) for n, m in out.issues()]
    return out


@dataclass(frozen=True)
class Config:
    raw: dict = field(default_factory=dict)
    sections: dict = field(default_factory=dict)
    overrides: dict = field(default_factory=dict)
    topic_prefix: str = ""

    def policy(self, section: str, message_type: str):
        """The policy of a message type: its override on the defaults."""
        return self.overrides.get((section, message_type), self.sections[section])

    def get(self, key: str):
        at = self.raw
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at


def discover(name: str, start: str | Path = ".") -> Path | None:
    """The nearest file of that name in a folder or those above it."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def resolve(raw: dict, required: dict[str, type] | None = None, env: dict | None = None, prefix_variable: str = "TIDEMARK_TOPIC_PREFIX") -> Config:
    """Checks everything and raises ConfigErrors with all issues. The topic prefix of the environment goes before that of the file."""
    issues, sections, overrides = [], {}, {}
    for name, make in SECTIONS.items():
        values = dict(raw.get(name, {}))
        special = values.pop("overrides", {}) if name in ("retry", "observability") else {}
        sections[name] = merged(make(), values, name, issues)
        for t, more in special.items():
            overrides[name, t] = merged(sections[name], more, f"{name}.overrides.{t}", issues)
    env = os.environ if env is None else env
    prefix = env.get(prefix_variable, raw.get("topics", {}).get("prefix", ""))
    if prefix and not re.fullmatch(r"[a-z0-9][a-z0-9.-]*[.-]", prefix):
        issues.append(("topics.prefix", "must match [a-z0-9][a-z0-9.-]* and end in . or -"))
    out = Config(raw, sections, overrides, prefix)
    for key, kind in (required or {}).items():
        value = out.get(key)
        if value is None:
            issues.append((key, f"has to be there, as {kind.__name__}"))
        elif not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            issues.append((key, f"isn't of type {kind.__name__}"))
    if issues:
        raise ConfigErrors(issues)
    return out


def load(path: str | Path, **kw) -> Config:
    return resolve(tomllib.loads(Path(path).read_text()), **kw)
