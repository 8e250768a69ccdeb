"""Settings from YAML files and the environment, read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import Any

from corpusloom.operators.quality import Thresholds


@dataclass(frozen=True)
class Prompt:
    """A labelling prompt with its generation limits and quality thresholds."""

    version: str = "0.0.0"
    model: str = ""
    system: str = ""
    user_template: str = ""
    temperature: float = 0.2
    top_p: float = 0.9
    max_output_tokens: int = 4096
    limits: Thresholds = Thresholds()
    response_schema: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Training:
    """What a trainer needs to know of the data and the model; the trainer itself is an adapter."""

    version: str = "1.0.0"
    run_name: str = "run"
    text_column: str = "content_text"
    target_column: str = "summary"
    base: str = ""
    max_input_length: int = 1024
    max_target_length: int = 128
    learning_rate: float = 5.0e-5
    num_train_epochs: float = 4.0
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """Where things are; each field can be set by ``CORPUSLOOM_<FIELD>``."""

    warehouse: str = "warehouse"
    dataset_root: str = "data/datasets"
    metrics_root: str = "metrics"


def _yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as text:
        return yaml.safe_load(text) or {}


#: A prompt's fields by section of its file (the first is the top), with their kinds and, for numbers, bounds.
PROMPT_FILE = {
    "": {"version": str, "model": str, "system": str, "user_template": str, "response_schema": dict},
    "generation_config": {"temperature": (float, 0, 2), "top_p": (float, 0, 1), "max_output_tokens": (int, 16, 8192)},
    "qc": {
        "min_words": (int, 1, None), "max_words": (int, 1, None), "min_sentences": (int, 1, None), "max_sentences": (int, 1, None),
        "entity_fuzzy_min_ratio": (float, 0, 1),
    },
}


def _checked(name: str, value: Any, rule: Any) -> Any:
    if not isinstance(rule, tuple):
        return rule(value or rule()) if rule is dict else str(value).strip()
    kind, low, high = rule
    number = kind(value)
    if number < low or (high is not None and number > high):
        raise ValueError(f"{name} is {value}; it must not be under {low}" + ("" if high is None else f" or over {high}"))
    return number


def load_prompt(path: str) -> Prompt:
    """A prompt from YAML; what is missing has its default, what is out of bounds raises ``ValueError``."""
    raw, found = _yaml(path), {}
    for section, rules in PROMPT_FILE.items():
        part = raw.get(section) or {} if section else raw
        found[section] = {name: _checked(name, part[name], rule) for name, rule in rules.items() if part.get(name) is not None}
    limits = {"fuzzy_ratio" if name == "entity_fuzzy_min_ratio" else name: value for name, value in found.pop("qc").items()}
    return Prompt(limits=Thresholds(**limits), **found[""], **found["generation_config"])


def load_training(path: str) -> Training:
    """Training settings from YAML sections; unknown keys are dropped, missing ones have their defaults."""
    raw = _yaml(path)
    flat = {k: v for part in (raw, *(raw.get(s) or {} for s in ("dataset", "model", "training"))) for k, v in part.items()}
    return Training(**{f.name: flat[f.name] for f in fields(Training) if f.name in flat})


def dotenv(path: str = ".env") -> dict[str, str]:
    """Names and values of a file of ``NAME=value`` lines; comments, blank lines and a missing file give nothing."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as text:
        pairs = (line.strip().removeprefix("export ").partition("=") for line in text if "=" in line and not line.lstrip().startswith("#"))
        return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


def settings(environment: dict[str, str] | None = None, file: str = ".env") -> Settings:
    """From the environment, else from the file, else the defaults."""
    env = dotenv(file) | dict(os.environ) if environment is None else environment
    return Settings(**{f.name: env[key] for f in fields(Settings) if (key := f"CORPUSLOOM_{f.name.upper()}") in env})


def model_parts(folder: str) -> dict[str, str | None]:
    """``base``, ``adapter`` and ``tokenizer`` of a model's folder, or of a name that is no folder.

    A folder with ``adapter_config.json`` is an adapter of the base model that the file
    names (it must), with the tokenizer of the folder if it has one, else of the base.
    """
    described = os.path.join(folder, "adapter_config.json")
    if not os.path.exists(described):
        return {"base": folder, "adapter": None, "tokenizer": folder}
    with open(described, encoding="utf-8") as text:
        base = json.load(text).get("base_model_name_or_path")
    if not base:
        raise ValueError(f"{described} names no base_model_name_or_path")
    return {"base": str(base), "adapter": folder, "tokenizer": folder if os.path.exists(os.path.join(folder, "tokenizer.json")) else str(base)}
