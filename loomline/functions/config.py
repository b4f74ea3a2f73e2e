"""Run settings: typed values and the order in which they override each other."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from loomline.operators.profile import LONG_BACKBONE, LONG_BATCH, LONG_LIMIT, LONG_MARK, SHORT_BACKBONE, SHORT_BATCH, SHORT_LIMIT
from loomline.sources.artifacts import load_json


@dataclass(frozen=True)
class RunConfig:
    """The settings of a run. Where a file nests one under a section of another name, ``_PLACES`` has its path."""

    dataset: str = "hdfs"
    seed: int = 42
    backbone: str = SHORT_BACKBONE
    window_seconds: int | None = None
    sentence_mask_ratio: float = 0.5
    token_mask_ratio: float = 0.8
    n_passes: int = 1
    epochs: int = 1
    max_lr: float | None = None
    lr_grid: tuple[float, ...] = ()
    effective_batch_size: int = 32
    physical_batch_size: int | None = None
    gradient_accumulation_steps: int = 1
    betas: tuple[float, ...] = ()
    eps: float | None = None
    weight_decay: float = 0.0
    pct_start: float | None = None
    anneal_strategy: str | None = None
    div_factor: float | None = None
    final_div_factor: float | None = None
    three_phase: bool = False
    epoch_1_unfrozen_layers: tuple[int, ...] = ()
    epoch_2_unfrozen_layers: tuple[int, ...] = ()
    epoch_3_plus_unfrozen_layers: str | None = None
    embeddings_frozen_until_epoch: int | None = None
    full_determinism: bool = False
    fp16: bool = False
    fp16_weight_divergence_threshold: float | None = None


# Places of settings in a configuration whose last key is not the setting's name.
_PLACES = {
    "sentence_mask_ratio": ("masking", "sentence_ratio"),
    "token_mask_ratio": ("masking", "token_ratio"),
    "full_determinism": ("determinism", "hf_full_determinism"),
}


def load_yaml(path: str | Path) -> dict:
    try:
        import yaml
    except ImportError as e:  # the only reader that needs it
        raise RuntimeError("reading YAML needs PyYAML") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def save_yaml(data: dict, path: str | Path) -> Path:
    """``data`` as YAML in its own order of keys, folders made as needed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("writing YAML needs PyYAML") from e
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(data, sort_keys=False), encoding="utf-8")
    return path


def number(value: object) -> float:
    """YAML reads ``1.0e4`` as text; both come out as a float."""
    return float(value)  # type: ignore[arg-type]


def resolve_backbone(config: dict, decision: str | Path | None = None) -> str:
    """``training.backbone`` if set; else the one a decision file chose; else the long or short one by ``training.use_longformer``.

    A decision file that is named must exist and hold ``chosen_backbone``, also where it is overridden.
    """
    training, names = config.get("training") or {}, config.get("backbone") or {}
    chosen = None
    if decision is not None:
        if not Path(decision).exists():
            raise FileNotFoundError(decision)
        chosen = load_json(decision).get("chosen_backbone")
        if not chosen:
            raise ValueError(f"{decision} has no chosen_backbone")
    if training.get("backbone") or chosen:
        return training.get("backbone") or chosen
    if training.get("use_longformer"):
        return names.get("longformer_id", LONG_BACKBONE)
    return names.get("roberta_id", SHORT_BACKBONE)


def _by_name(backbone: str, long: int, short: int) -> int:
    name = backbone.lower()
    if LONG_MARK in name:
        return long
    if "roberta" in name:
        return short
    raise ValueError(f"unknown backbone {backbone!r}")


def token_limit(backbone: str) -> int:
    return _by_name(backbone, LONG_LIMIT, SHORT_LIMIT)


def physical_batch(backbone: str) -> int:
    return _by_name(backbone, LONG_BATCH, SHORT_BATCH)


def batch_sizes(effective: int, physical: int) -> tuple[int, int]:
    """Rows a step and steps that are accumulated; the first must divide the effective size."""
    if effective < 1 or physical < 1 or effective % physical:
        raise ValueError(f"{effective} rows cannot be made of steps of {physical}")
    return physical, effective // physical


def steps_per_epoch(rows: int, physical: int, accumulated: int) -> int:
    """Updates of an epoch, a last partial one included; at least one."""
    return max(1, -(-rows // (physical * accumulated)))


def _flat(section: dict) -> dict[str, object]:
    """All settings of a configuration by their last key, however deep; those of inner sections win."""
    out: dict[str, object] = {k: v for k, v in section.items() if not isinstance(v, dict)}
    for inner in section.values():
        if isinstance(inner, dict):
            out |= _flat(inner)
    return out


def _typed(kind: str, value: object) -> object:
    """A value as the type a setting is declared with; numbers may be text."""
    kind = kind.removesuffix(" | None")
    if kind.startswith("tuple["):
        each = kind[6:].split(",")[0]
        return tuple(_typed(each, x) for x in value)  # type: ignore[union-attr]
    return {"int": lambda x: int(number(x)), "float": number, "bool": bool, "str": str}[kind](value)


def run_config(config: dict, decision: str | Path | None = None) -> RunConfig:
    """Settings from the sections of a configuration; unknown keys are left out, numbers may be text.

    Batch sizes follow from the backbone where the file has no physical one; one that does not divide the effective
    size raises.
    """
    found = _flat({k: v for k, v in config.items() if k != "backbone"})
    for name, (section, key) in _PLACES.items():
        value = (config.get(section) or {}).get(key)
        if value is not None:
            found[name] = value
    found["backbone"] = resolve_backbone(config, decision)
    out = {f.name: _typed(str(f.type), found[f.name]) for f in fields(RunConfig) if found.get(f.name) is not None}
    effective = out.get("effective_batch_size", RunConfig.effective_batch_size)
    physical = out.get("physical_batch_size") or physical_batch(out["backbone"])
    out["physical_batch_size"], out["gradient_accumulation_steps"] = batch_sizes(effective, physical)
    return RunConfig(**out)
