"""The feature catalog: declared features, checked strictly."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import yaml

DEFAULT_PATH = Path(__file__).with_name("feature_catalog.yaml")

# What each aggregation reads, and its value over an empty window.
SEMANTICS = {"sum": ("amount", 0), "count": ("transaction_id", 0), "time_since_last": ("event_ts", None)}
_NAME = re.compile(r"[a-z][a-z0-9_]*")
_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _checked(kind: type, raw: object, what: str) -> dict:
    """raw as keyword arguments of a dataclass: a mapping with exactly its keys."""
    if not isinstance(raw, dict):
        raise ValueError(f"{what} must be a mapping")
    known = [f.name for f in fields(kind)]
    for problem, names in (("unknown", set(raw) - set(known)), ("missing", set(known) - set(raw))):
        if names:
            raise ValueError(f"{what} has {problem} keys: {sorted(map(str, names))}")
    return raw


@dataclass(frozen=True)
class FeatureDefinition:
    name: str
    description: str
    entity: str
    aggregation: str
    source_column: str
    window_hours: int
    event_time: str
    version: str
    default_value: int | float | None

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not _NAME.fullmatch(self.name):
            raise ValueError(f"not a feature name: {self.name!r}")
        if not isinstance(self.description, str) or not self.description.strip():
            raise ValueError(f"{self.name}: a description is needed")
        object.__setattr__(self, "description", self.description.strip())
        if self.entity != "uid" or self.event_time != "event_ts":
            raise ValueError(f"{self.name}: entity must be uid and event_time event_ts")
        if self.aggregation not in SEMANTICS:
            raise ValueError(f"{self.name}: unknown aggregation {self.aggregation!r}")
        if isinstance(self.window_hours, bool) or not isinstance(self.window_hours, int) or self.window_hours <= 0:
            raise ValueError(f"{self.name}: window_hours must be a positive whole number")
        if not isinstance(self.version, str) or not _VERSION.fullmatch(self.version):
            raise ValueError(f"{self.name}: not a version: {self.version!r}")
        source, default = SEMANTICS[self.aggregation]
        if self.source_column != source:
            raise ValueError(f"{self.name}: {self.aggregation} reads {source}")
        if isinstance(self.default_value, bool) or self.default_value != default:
            raise ValueError(f"{self.name}: the default of {self.aggregation} is {default}")

    @property
    def window_us(self) -> int:
        return self.window_hours * 3_600_000_000


@dataclass(frozen=True)
class FeatureCatalog:
    version: str
    features: tuple[FeatureDefinition, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "features", tuple(self.features))
        if not isinstance(self.version, str) or not _VERSION.fullmatch(self.version):
            raise ValueError(f"not a version: {self.version!r}")
        if not self.features:
            raise ValueError("a catalog needs a feature")
        names = [f.name for f in self.features]
        if len(set(names)) < len(names):
            raise ValueError("feature names must differ")

    @property
    def max_lookback_hours(self) -> int:
        return max(f.window_hours for f in self.features)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def fingerprint(self) -> str:
        """First 16 hex digits of the SHA-256 of the catalog as canonical JSON: meaning counts, comments do not."""
        text = json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def from_mapping(raw: object) -> FeatureCatalog:
    found = _checked(FeatureCatalog, raw, "the catalog")
    if not isinstance(found["features"], list):
        raise ValueError("features must be a list")
    return FeatureCatalog(found["version"], tuple(FeatureDefinition(**_checked(FeatureDefinition, f, "a feature")) for f in found["features"]))


def load_catalog(path: str | Path = DEFAULT_PATH) -> FeatureCatalog:
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if raw is None:
        raise ValueError(f"the catalog file is empty: {path}")
    return from_mapping(raw)


def describe(catalog: FeatureCatalog) -> str:
    """One line per feature."""
    return "\n".join(f"{f.name}: {f.aggregation}({f.source_column}) over {f.window_hours} h, default {f.default_value}" for f in catalog.features)
