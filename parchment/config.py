"""Settings, read from and written to JSON on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from parchment.operators.archive import Limits


@dataclass(frozen=True)
class Ocr:
    language: str = "por"
    dpi: int = 200
    max_pages: int | None = None
    max_wait_s: float = 30.0


@dataclass(frozen=True)
class Settings:
    max_file_bytes: int = 100 << 20
    ocr: Ocr = field(default_factory=Ocr)
    archives: Limits = field(default_factory=Limits)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Unknown names are left aside; a missing file is an error."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))

        def make(kind, values):
            return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})

        top = {k: v for k, v in given.items() if k == "max_file_bytes"}
        return cls(**top, ocr=make(Ocr, given.get("ocr", {})), archives=make(Limits, given.get("archives", {})))

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
