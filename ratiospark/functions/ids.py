"""Stable identifiers of configurations and runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)


def stable_id(value: object, length: int = 16) -> str:
    """First hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def stable_id_column(value: Column, length: int = 16) -> Column:
    """``stable_id`` of a struct of columns, whose fields are given in order of their names; made where the rows are."""
    return F.left(F.sha2(F.to_json(value), 256), F.lit(length))


def run_id(data_id: str, split_id: str, fold_id: int, config_id: str) -> str:
    return stable_id({"config_id": config_id, "data_id": data_id, "fold_id": fold_id, "split_id": split_id})


def model_label(name: str, config: Mapping[str, object], known: tuple[str, ...] = ("rho", "keep", "mode", "alpha")) -> str:
    """the name with the hyperparameters worth showing."""
    parts = [f"{k}={config[k]}" for k in known if k in config]
    return f"{name}({', '.join(parts)})" if parts else name
