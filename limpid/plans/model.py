"""The cleaning plan: what to do with every column, with duplicates and with outliers.

A plan has O(columns) entries and lives on the driver. Its JSON form has the keys ``columns``,
``duplicates``, ``outliers``, ``custom_transforms``, ``_metadata`` and ``_eda``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from limpid.functions.constants import FILL_STRATEGIES, NORMALIZE_KINDS, OUTLIER_STRATEGIES, PLAN_TYPES

IDENTIFIER_RE = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


class PlanError(ValueError):
    """A plan does not follow its schema; ``errors`` lists every fault."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def is_identifier(name: Any) -> bool:
    return isinstance(name, str) and IDENTIFIER_RE.fullmatch(name) is not None


@dataclass
class MissingRule:
    strategy: str = "drop_row"
    value: Any = None
    null_count: int | None = None

    def errors(self, where: str) -> list[str]:
        out = []
        if self.strategy not in FILL_STRATEGIES:
            out.append(f"{where}.strategy={self.strategy!r} must be one of {list(FILL_STRATEGIES)}")
        if self.strategy == "fill" and self.value is None:
            out.append(f"{where}: a value is required when strategy is 'fill'")
        if self.value is not None and not isinstance(self.value, (str, int, float)):
            out.append(f"{where}.value must be text or a number")
        return out


@dataclass
class ColumnRule:
    type: str = "string"
    nullable: bool = True
    missing_values: MissingRule | None = None
    normalize: str | bool = False
    warnings: list[str] = field(default_factory=list)
    note: str | None = None
    rename_to: str | None = None
    sentinel_values: list | None = None
    replace_sentinels: bool = True
    transform_hint: str | None = None
    transform_code: str | None = None
    sentinel_table: str | None = None

    def errors(self, where: str) -> list[str]:
        out = []
        if self.type not in PLAN_TYPES:
            out.append(f"{where}.type={self.type!r} must be one of {list(PLAN_TYPES)}")
        if self.normalize not in NORMALIZE_KINDS or self.normalize is True:
            out.append(f"{where}.normalize={self.normalize!r} must be 'min_max', 'z_score' or false")
        if self.rename_to is not None and not is_identifier(self.rename_to):
            out.append(f"{where}.rename_to={self.rename_to!r} is not an identifier")
        if self.missing_values is not None:
            out += self.missing_values.errors(f"{where}.missing_values")
        return out


@dataclass
class DuplicateRule:
    strategy: str = "ignore"
    subset: list[str] = field(default_factory=list)
    keep: str = "first"

    def errors(self) -> list[str]:
        out = []
        if self.strategy not in ("drop", "ignore"):
            out.append(f"duplicates.strategy={self.strategy!r} must be 'drop' or 'ignore'")
        if self.keep not in ("first", "last"):
            out.append(f"duplicates.keep={self.keep!r} must be 'first' or 'last'")
        return out


@dataclass
class OutlierRule:
    strategy: str = "keep"
    method: str = "iqr"
    lower: float | None = None
    upper: float | None = None
    count: int | None = None
    note: str | None = None

    def errors(self, where: str) -> list[str]:
        out = []
        if self.strategy not in OUTLIER_STRATEGIES:
            out.append(f"{where}.strategy={self.strategy!r} must be one of {list(OUTLIER_STRATEGIES)}")
        if self.method != "iqr":
            out.append(f"{where}.method={self.method!r} must be 'iqr'")
        return out


def _build(cls, data: dict, where: str, errors: list[str]):
    """Dataclass from a dict; unknown keys are ignored, as stored plans may carry extra ones."""
    if not isinstance(data, dict):
        errors.append(f"{where} must be an object")
        return cls()
    known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
    return cls(**known)


def _dump(obj) -> dict:
    return {k: v for k, v in vars(obj).items() if v is not None}


@dataclass
class Plan:
    columns: dict[str, ColumnRule] = field(default_factory=dict)
    duplicates: DuplicateRule | None = None
    outliers: dict[str, OutlierRule] = field(default_factory=dict)
    custom_transforms: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    eda: dict | None = None

    def errors(self) -> list[str]:
        out = []
        for name, rule in self.columns.items():
            out += rule.errors(f"columns[{name!r}]")
        for name, rule in self.outliers.items():
            out += rule.errors(f"outliers[{name!r}]")
        if self.duplicates is not None:
            out += self.duplicates.errors()
        return out + self._rename_clashes()

    def _rename_clashes(self) -> list[str]:
        removed = {n for n, r in self.columns.items()
                   if r.missing_values and r.missing_values.strategy == "drop_column"}
        final: dict[str, str] = {}
        out = []
        for name, rule in self.columns.items():
            if name in removed:
                continue
            target = rule.rename_to or name
            if target in final:
                out.append(f"columns {final[target]!r} and {name!r} would both be named {target!r}")
            final[target] = name
        return out

    def checked(self) -> Plan:
        found = self.errors()
        if found:
            raise PlanError(found)
        return self

    @classmethod
    def from_dict(cls, data: dict) -> Plan:
        """Parse and validate; raises :class:`PlanError` with all faults."""
        errors: list[str] = []
        columns = {}
        for name, raw in (data.get("columns") or {}).items():
            rule = _build(ColumnRule, raw, f"columns[{name!r}]", errors)
            if isinstance(rule.missing_values, dict):
                rule.missing_values = _build(MissingRule, rule.missing_values, f"columns[{name!r}].missing_values", errors)
            rule.warnings = list(rule.warnings or [])
            columns[name] = rule
        duplicates = data.get("duplicates")
        plan = cls(
            columns,
            _build(DuplicateRule, duplicates, "duplicates", errors) if duplicates is not None else None,
            {n: _build(OutlierRule, o, f"outliers[{n!r}]", errors) for n, o in (data.get("outliers") or {}).items()},
            list(data.get("custom_transforms") or []),
            dict(data.get("_metadata") or {}),
            data.get("_eda"),
        )
        errors += plan.errors()
        if errors:
            raise PlanError(errors)
        return plan

    def to_dict(self) -> dict:
        """JSON form without empty fields."""
        columns = {}
        for name, rule in self.columns.items():
            d = _dump(rule)
            if rule.missing_values is not None:
                d["missing_values"] = _dump(rule.missing_values)
            columns[name] = d
        out: dict = {"columns": columns}
        if self.duplicates is not None:
            out["duplicates"] = _dump(self.duplicates)
        out["outliers"] = {n: _dump(o) for n, o in self.outliers.items()}
        out["custom_transforms"] = self.custom_transforms
        out["_metadata"] = self.metadata
        if self.eda is not None:
            out["_eda"] = self.eda
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        return cls.from_dict(json.loads(text))

    def copy(self) -> Plan:
        return Plan.from_dict(json.loads(self.to_json()))
