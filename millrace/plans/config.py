"""Run configuration: inheritance, overrides, validation, fingerprint. Driver-side; no DataFrame is involved.

A file's chain of parents is walked first, as a list; its settings are then one
fold of flat, dotted settings, so nothing nested is ever merged. Settings are
checked against the dataclasses' own types at the end.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

try:
    import yaml
except ImportError:  # JSON is a subset of YAML; configuration files may then be JSON only
    yaml = None


@dataclass
class LoraConfig:
    r: int = 16
    alpha: int = 32
    dropout: float = 0.05
    target_modules: list[str] = field(default_factory=lambda: ["q_proj", "v_proj"])


@dataclass
class QuantConfig:
    enabled: bool = False
    bits: int = 4


@dataclass
class TrainConfig:
    epochs: int = 3
    batch_size: int = 16
    learning_rate: float = 2e-4
    eval_per_epoch: int = 4
    patience: int = 3
    threshold: float = 1e-4
    max_seq_length: int = 1024


#: Mark of settings that don't affect a run's result, and so not its fingerprint.
_BESIDE = {"beside": True}


@dataclass
class RunConfig:
    name: str = field(default="run", metadata=_BESIDE)
    notes: str = field(default="", metadata=_BESIDE)
    model: str = ""
    data_dir: str = "data"
    output_root: str = field(default="runs", metadata=_BESIDE)
    tracker: str = field(default="local", metadata=_BESIDE)
    project: str = field(default="", metadata=_BESIDE)
    seed: int = 13
    lora: LoraConfig = field(default_factory=LoraConfig)
    quant: QuantConfig = field(default_factory=QuantConfig)
    train: TrainConfig = field(default_factory=TrainConfig)


def settings_of(config: Any, prefix: str = "", beside: bool = True) -> dict[str, Any]:
    """A configuration as flat, dotted settings; without those that are beside the result if asked."""
    flat: dict[str, Any] = {}
    for f in fields(config):
        value = getattr(config, f.name)
        if f.metadata.get("beside") and not beside:
            continue
        if is_dataclass(value):
            flat |= settings_of(value, f"{prefix}{f.name}.", beside)
        else:
            flat[prefix + f.name] = value
    return flat


def fingerprint(config: RunConfig) -> str:
    """Twelve hex digits that agree for runs whose results should."""
    lines = [f"{k}={json.dumps(v)}" for k, v in sorted(settings_of(config, beside=False).items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12]


def flattened(values: dict, prefix: str = "") -> dict[str, Any]:
    """Nested settings under dotted names."""
    flat: dict[str, Any] = {}
    for k, v in values.items():
        flat |= flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return flat


def nested(flat: dict[str, Any]) -> dict[str, Any]:
    """Dotted names as nested mappings, in order."""
    tree: dict[str, Any] = {}
    for name, value in flat.items():
        *above, last = name.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[last] = value
    return tree


def known_settings(kind: type = RunConfig, prefix: str = "") -> dict[str, type]:
    """Every setting there is, with its type."""
    found: dict[str, type] = {}
    for name, hint in get_type_hints(kind).items():
        found |= known_settings(hint, f"{prefix}{name}.") if is_dataclass(hint) else {prefix + name: hint}
    return found


def accepted(value: Any, hint: type) -> bool:
    if hint is float:
        return isinstance(value, int | float) and not isinstance(value, bool)
    if hint is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, getattr(hint, "__origin__", hint))


def build(flat: dict[str, Any]) -> RunConfig:
    """A configuration of these settings; a name that is no setting, or a value of another type, is an error."""
    known = known_settings()
    wrong = [f"{k} is no setting" for k in sorted(set(flat) - set(known))]
    wrong += [f"{k} is {v!r}, not {known[k]}" for k, v in flat.items() if k in known and not accepted(v, known[k])]
    if wrong:
        raise ValueError("; ".join(wrong))
    config = RunConfig()
    for name, value in flat.items():
        *above, last = name.split(".")
        holder = config
        for part in above:
            holder = getattr(holder, part)
        setattr(holder, last, value)
    return config


def read(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    return (yaml.safe_load(text) if yaml else json.loads(text)) or {}


def chain(path: str | Path) -> list[dict[str, Any]]:
    """The settings of a file and of all files above it, topmost first. A parent is looked for beside its child, then as given."""
    at, seen, found = Path(path).resolve(), [], []
    while at is not None:
        if at in seen:
            raise ValueError("a circle of files: " + " > ".join(p.name for p in [*seen, at]))
        if not at.is_file():
            raise FileNotFoundError(f"no configuration file {at}" + (f", which {seen[-1].name} names" if seen else ""))
        seen.append(at)
        settings = read(at)
        above = settings.pop("extends", None)
        found.append(settings)
        if above:
            beside = at.parent / above
            at = (beside if beside.is_file() else Path(above)).resolve()
        else:
            at = None
    return found[::-1]


def scalar(text: str) -> Any:
    """A setting given as text: JSON where it is that, a number where Python reads one (1e-4), else the text."""
    for reading in (json.loads, float):
        try:
            return reading(text)
        except ValueError:
            continue
    return text


def overrides(pairs: list[str]) -> dict[str, Any]:
    """["train.epochs=2"] -> {"train.epochs": 2}"""
    bad = [p for p in pairs if "=" not in p]
    if bad:
        raise ValueError(f"no key=value: {bad[0]!r}")
    return {k.strip(): scalar(v) for k, v in (p.split("=", 1) for p in pairs)}


def load(path: str | Path, pairs: list[str] | None = None) -> RunConfig:
    """The configuration of a file: its chain from the top, then `pairs`, later settings over earlier ones."""
    flat: dict[str, Any] = {}
    for settings in chain(path):
        flat |= flattened(settings)
    return build(flat | overrides(pairs or []))


def save(config: RunConfig, path: str | Path) -> None:
    """The configuration as a file that load() reads, and its fingerprint in a file beside it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    values = nested(settings_of(config))
    path.write_text(yaml.safe_dump(values, sort_keys=False) if yaml else json.dumps(values, indent=2), encoding="utf-8")
    path.with_suffix(".fingerprint").write_text(fingerprint(config) + "\n", encoding="utf-8")
