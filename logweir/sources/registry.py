"""Saved formats by file signature, in a JSON file beside the work."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from ..operators.custom import ColumnSpec, PatternSpec

Spec = PatternSpec | ColumnSpec


def to_spec(data: dict) -> Spec:
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    if values.get("kind") == "pattern":
        values["levels"] = {k: tuple(v) for k, v in values.get("levels", {}).items()}
        return PatternSpec(**values)
    return ColumnSpec(**values)


class FormatRegistry:
    """A missing or damaged file counts as empty."""

    def __init__(self, path: str | None = None):
        self.path, self._held = path, {}

    def known(self) -> dict[str, Spec]:
        if self.path is None:
            return dict(self._held)
        try:
            with open(self.path, encoding="utf-8") as src:
                return {k: to_spec(v) for k, v in json.load(src).items()}
        except (OSError, ValueError, TypeError, AttributeError):
            return {}

    def find(self, signature: str) -> Spec | None:
        return self.known().get(signature)

    def save(self, signature: str, spec: Spec) -> None:
        self._write(self.known() | {signature: spec})

    def remove(self, signature: str) -> None:
        self._write({k: v for k, v in self.known().items() if k != signature})

    def _write(self, formats: dict[str, Spec]) -> None:
        self._held = formats
        if self.path is not None:
            with open(part := f"{self.path}.new", "w", encoding="utf-8") as out:
                json.dump({k: asdict(v) for k, v in formats.items()}, out, indent=1)
            os.replace(part, self.path)
