"""Run settings, with validation."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class IngestConfig:
    adapt_glob: str
    replay_glob: str
    out: str
    tokenizer: str | None = None
    block_size: int = 4096
    eod_id: int = 2
    bos_id: int | None = None
    holdout_fraction: float = 0.01
    holdout_floor: int = 0
    max_docs_adapt: int | None = None
    max_docs_replay: int | None = None
    max_blocks_per_domain: int | None = None
    max_blocks_adapt: int | None = None
    max_blocks_replay: int | None = None
    max_blocks_per_origin: int | None = None
    adapt_doc_fraction: float = 1.0
    replay_doc_fraction: float = 1.0
    per_subset: bool = True
    origin_map: dict[str, str] | None = None
    capability_map: dict[str, str] | None = None
    text_column: str = "text"
    shard_rows: int = 50_000
    buckets: int | None = None
    by_dictionary: bool = False
    adapt_domain: str = "legal"
    replay_domain: str = "general"
    balance_replay: bool = False
    seed: int = 42


@dataclass(frozen=True)
class MixerConfig:
    corpus_path: str
    adapt_domain: str
    replay_share: float = 1.0
    allow_missing_fraction: float = 0.0
    max_val_samples_per_origin: int | None = None
    ref_loss_cache_path: str | None = None
    curriculum_trace_dirs: tuple[str, ...] = ()
    curriculum_batch_size: int | None = None
    full_val_holdout: bool = True
    max_blocks: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class TrainConfig:
    pool_size: int
    top_k: int
    selection_strategy: str = "top_k"
    fixed_replay_ratio: float = 0.25
    enable_selection: bool = True
    rich_log_period: int = 50
    log_selected: bool = False
    log_selected_period: int = 1
    max_steps: int | None = None
    max_epochs: int = 1
    val_period: int = 0
    val_batches: int = 0
    val_at_start: bool = False
    save_period: int = 0
    timeout_s: float | None = None
    devices: int = 1
    curriculum: bool = False
    shuffle: bool = True
    shuffle_chunk: int = 1
    seed: int = 42

    def __post_init__(self):
        if self.curriculum and (self.shuffle or self.enable_selection):
            raise ValueError("a curriculum needs shuffle=False and enable_selection=False")
        if self.top_k > self.pool_size:
            raise ValueError("top_k exceeds the pool")


@dataclass(frozen=True)
class RunConfig:
    mixer: MixerConfig
    train: TrainConfig
    env: dict[str, Any] = field(default_factory=dict)


def read_settings(path: str) -> dict:
    """A JSON or YAML file of nested settings; an empty one has none."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError(f"{path}: YAML settings need the yaml package; JSON needs none") from e
            found = yaml.safe_load(f)
        else:
            found = json.load(f)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found or {}


def override(text: str) -> dict:
    """``a.b=value`` as nested settings; the value is JSON where it can be
    (numbers, true, null, lists) and else a string. A leading ``+`` is allowed."""
    name, sign, value = text.lstrip("+").partition("=")
    if not sign or not name:
        raise ValueError(f"an override is name=value, not {text!r}")
    try:
        found: Any = json.loads(value)
    except ValueError:
        found = value
    for part in reversed(name.split(".")):
        found = {part: found}
    return found


def merged(*layers: dict) -> dict:
    """Nested settings, later layers over earlier ones, ``${NAME}`` from the
    environment in strings."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged(out[k], v)
            else:
                out[k] = os.path.expandvars(v) if isinstance(v, str) else v
    return out


def build(kind: type, values: dict, strict: bool = False):
    """``kind`` from nested dicts; all missing fields are named in one error,
    unknown ones are warned of or, if strict, an error."""
    missing: list[str] = []
    extra: list[str] = []

    def make(kind: type, values: dict, path: str):
        known = {f.name: f for f in fields(kind)}
        extra.extend(f"{path}{k}" for k in values if k not in known)
        args = {}
        for name, f in known.items():
            inner = globals().get(f.type) if isinstance(f.type, str) else f.type
            if name in values:
                args[name] = make(inner, values[name], f"{path}{name}.") if is_dataclass(inner) else values[name]
            elif f.default is MISSING and f.default_factory is MISSING:
                missing.append(f"{path}{name}")
        return None if missing else kind(**args)

    out = make(kind, values, "")
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    if extra:
        if strict:
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        log.warning("unknown settings: %s", ", ".join(extra))
    return out


def as_dict(config) -> dict:
    return dataclasses.asdict(config)
