"""Dataset contract: which keys a record must carry and which tasks it may name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import yaml


class DatasetError(ValueError):
    """Base of all errors about a dataset or its configuration."""


class ContractError(DatasetError):
    """The contract itself is malformed."""


class MalformedLineError(DatasetError):
    """A line is not a JSON object."""


class InvalidDatasetError(DatasetError):
    """At least one record breaks the contract."""


@dataclass(frozen=True)
class Contract:
    required_fields: tuple[str, ...]
    meta_required: tuple[str, ...]
    tasks: tuple[str, ...]

    @classmethod
    def from_mapping(cls, raw: Any) -> Contract:
        if not isinstance(raw, Mapping):
            raise ContractError("contract root must be a mapping")
        for section in ("dataset", "task"):
            if section not in raw:
                raise ContractError(f"contract lacks the '{section}' section")
            if not isinstance(raw[section], Mapping):
                raise ContractError(f"contract section '{section}' must be a mapping")
        dataset = raw["dataset"]
        meta = dataset.get("meta_fields") or {}
        if not isinstance(meta, Mapping):
            raise ContractError("'meta_fields' must be a mapping")
        tasks = raw["task"].get("required")
        if not tasks:
            raise ContractError("'task.required' must name at least one task")
        return cls(
            _names(dataset.get("required_fields", ()), "dataset.required_fields"),
            _names(meta.get("required", ()), "dataset.meta_fields.required"),
            _names(tasks, "task.required"),
        )

    @classmethod
    def from_text(cls, text: str) -> Contract:
        """Parse YAML (and so JSON) text."""
        return cls.from_mapping(yaml.safe_load(text))

    @classmethod
    def load(cls, path: str, spark=None) -> Contract:
        """Read a contract file; with a session any Hadoop path works."""
        if spark is not None:
            return cls.from_text(spark.read.text(path, wholetext=True).first()[0])
        with open(path, encoding="utf-8") as handle:
            return cls.from_text(handle.read())


def _names(value: Any, where: str) -> tuple[str, ...]:
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        raise ContractError(f"'{where}' must be a list of names")
    return tuple(value)


DEFAULT_CONTRACT = Contract(
    required_fields=("id", "meta", "task"),
    meta_required=("grammar_rev", "seed", "split", "template_index"),
    tasks=("lm", "seq2seq", "cls"),
)
