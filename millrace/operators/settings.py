"""Settings of a run on the driver: merging, coercion, checks, alert channels."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from typing import Any

#: Sources and alert channels, in their order.
SOURCES = ("greenhouse", "lever", "adzuna", "linkedin_email")
CHANNELS = ("console", "file", "command", "email")


def merged(base: Mapping, over: Any) -> dict:
    """base with over's values: mappings merge by key, all else replaces; null says nothing."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items() if isinstance(over, Mapping) else ():
        if v is None and k in out:
            continue
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def from_environment(settings: Mapping, names: Mapping[str, str], environment: Mapping[str, str] | None = None) -> dict:
    """settings with values of the environment: names maps a variable to a dotted path."""
    out, environment = copy.deepcopy(dict(settings)), os.environ if environment is None else environment
    for variable, path in names.items():
        if value := environment.get(variable, "").strip():
            *way, last = path.split(".")
            at = out
            for step in way:
                at = at.setdefault(step, {})
            at[last] = value
    return out


def value(settings: Mapping, path: str, default: Any = None) -> Any:
    for step in path.split("."):
        if not isinstance(settings, Mapping) or step not in settings:
            return default
        settings = settings[step]
    return default if settings is None else settings


def terms(x: Any) -> list[str]:
    """A text or a list as search terms: lower case, single blanks, no empty ones."""
    many = [] if x is None else [x] if isinstance(x, str) else list(x) if isinstance(x, (list, tuple, set)) else []
    return [t for t in (" ".join(str(i).lower().split()) for i in many) if t]


def countries(x: Any) -> list[str]:
    return [t.upper() for t in terms(x)]


def number(x: Any, default: float, kind: type = float) -> float:
    """A number, or the default where x is none; true and false are none."""
    try:
        return default if isinstance(x, bool) or x is None else kind(x)
    except (TypeError, ValueError):
        return default


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def problems(settings: Mapping) -> list[str]:
    """All that is wrong with the settings, each as a rule and a path; an empty list is good to go."""
    out = []
    email = str(value(settings, "applicant.email", "")).strip()
    if not str(value(settings, "applicant.name", "")).strip():
        out.append("missing applicant.name")
    if not email:
        out.append("missing applicant.email")
    elif "@" not in email or "." not in email.rpartition("@")[2]:
        out.append("malformed applicant.email")
    provider = value(settings, "llm.provider", "anthropic")
    if provider not in ("anthropic", "openrouter"):
        out.append("unknown llm.provider")
    elif not value(settings, f"keys.{provider}"):
        out.append(f"missing keys.{provider}")
    if provider == "openrouter":
        out += [f"unqualified {p}" for p in ("scoring.model", "tailoring.model") if value(settings, p) and "/" not in str(value(settings, p))]
    threshold, age = value(settings, "scoring.threshold", 65), value(settings, "freshness.max_age_hours", 24)
    if not _is_number(threshold) or not 0 <= threshold <= 100:
        out.append("out of range scoring.threshold")
    if not _is_number(age) or age <= 0:
        out.append("out of range freshness.max_age_hours")
    on = [s for s in SOURCES if value(settings, f"sources.{s}", False)]
    if not on:
        out.append("missing sources")
    if "adzuna" in on and not (value(settings, "keys.adzuna_app_id") and value(settings, "keys.adzuna_app_key")):
        out.append("missing keys.adzuna_app_id")
    out += [f"missing watchlist.{s}" for s in ("greenhouse", "lever") if s in on and not value(settings, f"watchlist.{s}")]
    if value(settings, "apply.enabled", False) and not value(settings, "apply.dry_run", True) and not str(value(settings, "applicant.phone", "")).strip():
        out.append("missing applicant.phone")
    return out


def channels(settings: Mapping) -> list[str]:
    """Alert channels that are on: true, a text that isn't blank, or a mapping that doesn't say otherwise."""
    given = value(settings, "notify.channels", {})
    given = given if isinstance(given, Mapping) else {}

    def on(x: Any) -> bool:
        return x is True or (isinstance(x, str) and bool(x.strip())) or (isinstance(x, Mapping) and bool(x) and bool(x.get("enabled", True)))

    return [c for c in CHANNELS if on(given.get(c))]


def send(alerts: list[str], settings: Mapping, senders: Mapping) -> dict[str, str | None]:
    """Each channel that is on with its error, null where it was sent. senders: channel -> function(alerts, its settings). One failure costs no other channel."""
    out: dict[str, str | None] = {}
    for c in channels(settings):
        try:
            senders[c](alerts, value(settings, f"notify.channels.{c}"))
            out[c] = None
        except Exception as e:  # whatever a channel throws is its own
            out[c] = f"{type(e).__name__}: {e}"
    return out


def alert_file(path: str):
    """A sender that keeps a file while there are alerts, and deletes it where there are none."""

    def write(alerts: list[str], _settings: Any) -> None:
        if alerts:
            with open(path, "w", encoding="utf-8") as f:
                f.write("\n".join(alerts) + "\n")
        elif os.path.exists(path):
            os.remove(path)

    return write
