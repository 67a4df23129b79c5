"""Configuration of the three jobs as frozen dataclasses, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Data:
    train_librispeech_dir: str = ""
    test_librispeech_dir: str = ""
    train_csv: str = ""
    test_csv: str = ""


@dataclass(frozen=True)
class LstmConfig:
    hidden_size: int = 64
    num_layers: int = 3
    frame_aggregation_mean: bool = True


@dataclass(frozen=True)
class TransformerConfig:
    dim: int = 32
    num_encoder_layers: int = 2
    num_heads: int = 8


@dataclass(frozen=True)
class Model:
    saved_model_path: str = ""
    n_mfcc: int = 128
    seq_len: int = 100
    sliding_window_step: int = 50
    use_transformer: bool = False
    lstm: LstmConfig = field(default_factory=LstmConfig)
    transformer: TransformerConfig = field(default_factory=TransformerConfig)


@dataclass(frozen=True)
class SpecAug:
    use_specaug: bool = True
    freq_mask_prob: float = 0.3
    time_mask_prob: float = 0.3
    freq_mask_max_width: int = 16
    time_mask_max_width: int = 10


@dataclass(frozen=True)
class Train:
    triplet_alpha: float = 0.1
    batch_size: int = 8
    learning_rate: float = 0.0001
    save_model_frequency: int = 1000
    num_steps: int = 10000
    num_processes: int = 8
    specaug: SpecAug = field(default_factory=SpecAug)


@dataclass(frozen=True)
class Eval:
    full_sequence_inference: bool = False
    num_triplets: int = 1000
    threshold_step: float = 0.001


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    train: Train = field(default_factory=Train)
    eval: Eval = field(default_factory=Eval)


def build(kind: type, values: dict[str, Any] | None, where: str = "") -> Any:
    values = values or {}
    hints = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(where + k for k in unknown))}")
    return kind(**{k: build(hints[k], v, f"{where}{k}.") if is_dataclass(hints[k]) else v for k, v in values.items() if v is not None})


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return build(Config, yaml.safe_load(f))
