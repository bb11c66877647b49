"""Where languages and frameworks are plugged in: a language parses files, its frameworks find entry points and add signals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths
from ..operators.signals import Signal, default_signals
from ..sources import parse


@dataclass(frozen=True)
class Framework:
    """``entry_points`` reads call edges and imports; ``applies`` tells from the imports whether the project uses it at all."""

    name: str
    applies: Callable[[DataFrame], bool]
    entry_points: Callable[[DataFrame, DataFrame], DataFrame]
    signals: Callable[[], Sequence[Signal]] = tuple


@dataclass(frozen=True)
class Language:
    """``parse`` turns files (file_ord, path, content) of a project into tables; ``applies`` reads what is said of the project."""

    name: str
    applies: Callable[[str, Sequence[str]], bool]
    parse: Callable[[DataFrame, str], parse.Parsed]
    signals: Callable[[], Sequence[Signal]]
    frameworks: Sequence[Framework] = field(default_factory=tuple)

    def used(self, imports: DataFrame) -> list[Framework]:
        return [f for f in self.frameworks if f.applies(imports)]


def imports_module(module: str) -> Callable[[DataFrame], bool]:
    """Does any file import the module?"""
    return lambda imports: not imports.where(F.col("module") == module).isEmpty()


EXPRESS = Framework("express", imports_module("express"), lambda edges, imports: paths.entry_points(edges, imports, "express"))
JAVASCRIPT = Language(
    "javascript-typescript",
    lambda language, frameworks: language in ("typescript", "javascript") or bool({"node", "react"} & set(frameworks)),
    parse.parse,
    default_signals,
    (EXPRESS,),
)
