"""Settings of the detectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntFlag


@dataclass(frozen=True)
class DetectConfig:
    """Search for similar blocks. ``mode``: ``compat`` gives up early on hopeless pairs, ``exact`` is the plain blend."""

    threshold: float = 0.80
    window: int = 10
    min_shared: int = 3
    text_weight: float = 0.0
    mode: str = "compat"


@dataclass(frozen=True)
class IntraConfig:
    """Search for repeated regions inside one block."""

    min_region: int = 20
    threshold: float = 0.80
    window: int = 10
    text_weight: float = 0.0
    max_positions: int = 50


class Scope(IntFlag):
    """Where copies are looked for."""

    NONE = 0
    INTER_FILE = 1
    INTRA_FILE = 2
    INTRA_FUNCTION = 4
    INTER_FUNCTION = 3
    ALL = 7

    @classmethod
    def parse(cls, text: str) -> Scope:
        """From a comma-separated list of names; blanks and case don't matter, an empty list is an error."""
        known = {"inter-file": cls.INTER_FILE, "intra-file": cls.INTRA_FILE, "intra-function": cls.INTRA_FUNCTION, "inter-function": cls.INTER_FUNCTION, "all": cls.ALL}
        out, any_part = cls.NONE, False
        for part in text.split(","):
            name = part.strip(" \t\r\n").lower()
            if not name:
                continue
            if name not in known:
                raise ValueError(f"unknown scope: {name}")
            out, any_part = out | known[name], True
        if not any_part:
            raise ValueError("empty scope")
        return out

    def text(self) -> str:
        if self == Scope.ALL:
            return "all"
        names = [name for bit, name in ((Scope.INTER_FILE, "inter-file"), (Scope.INTRA_FILE, "intra-file"), (Scope.INTRA_FUNCTION, "intra-function")) if self & bit]
        return ", ".join(names) or "none"


@dataclass(frozen=True)
class AnalysisConfig:
    """One analysis of a directory."""

    root: str = "."
    threshold: float = 0.80
    min_tokens: int = 30
    text_weight: float = 0.3
    scope: Scope = Scope.ALL
    globs: tuple[str, ...] = ()
    encoding: str = "auto"
    respect_ignore: bool = False
    mode: str = "compat"
    extensions: tuple[str, ...] = field(default=())
