"""Settings of a run: read from a file, checked, and given as plain values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from chatloom.schema import FORMATS

# Names of a settings file, in the order in which they are looked for.
NAMES = ("config.yaml", "config.yml", "config.json", "settings.yaml", "settings.yml", "settings.json")


@dataclass
class Settings:
    """What a run keeps, drops and writes. The limits of ``check`` are fixed values."""

    confidence: float = 0.7
    attempts: int = 3
    format: str = "json"
    formats: list[str] = field(default_factory=list)
    directory: str = "./output"
    deduplicate: bool = True
    aggressive: bool = False
    exclude_fields: list[str] = field(default_factory=list)
    exclude_system: bool = True
    exclude_times: bool = False
    time_patterns: list[str] = field(default_factory=list)

    def check(self) -> Settings:
        """The settings themselves; ValueError with all that is out of range."""
        wrong = []
        if not 0.0 <= self.confidence <= 1.0:
            wrong.append("confidence must be from 0 to 1")
        if not 1 <= self.attempts <= 10:
            wrong.append("attempts must be from 1 to 10")
        if unknown := [f for f in [self.format, *self.formats] if f.lower() not in FORMATS]:
            wrong.append(f"unknown formats: {', '.join(unknown)}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def as_dict(self) -> dict:
        return asdict(self)


def find(folder: str) -> Path | None:
    """The settings file of a folder, by the first name that is there."""
    return next((p for n in NAMES if (p := Path(folder) / n).is_file()), None)


def load(folder: str) -> Settings:
    """The checked settings of a folder, defaults where a file or an entry is missing; entries under ``output`` and at the
    top count alike, others are ignored. YAML needs its library."""
    path = find(folder)
    if path is None:
        return Settings()
    raw = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        found = json.loads(raw)
    else:
        import yaml

        found = yaml.safe_load(raw)
    found = found if isinstance(found, dict) else {}
    merged = {**found, **(found.get("output") if isinstance(found.get("output"), dict) else {})}
    return Settings(**{f.name: merged[f.name] for f in fields(Settings) if f.name in merged}).check()
