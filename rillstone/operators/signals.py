"""Signals by which a file's role is guessed: a name, a weight and a condition on path and imports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ids import base_name

HIGH, MEDIUM, LOW = 3, 2, 1


@dataclass(frozen=True)
class Signal:
    """``when`` is a condition on the columns ``path`` and ``modules`` (imported modules)."""

    name: str
    role: str
    weight: int
    when: Column


def under(*folders: str) -> Column:
    """The path has one of these folders."""
    return F.col("path").rlike(f"(^|/)({'|'.join(folders)})(/|$)")


def imports_any(*packages: str) -> Column:
    hit = lambda m: reduce(lambda a, b: a | b, [(m == p) | m.startswith(p + "/") for p in packages])
    return F.coalesce(F.exists("modules", hit), F.lit(False))


def default_signals() -> list[Signal]:
    """In the order that decides ties. The names, folders and packages are fixed values."""
    path, name = F.col("path"), base_name(F.col("path"))
    jsx = path.rlike(r"\.(tsx|jsx)$")
    return [
        Signal("path:tests", "test", HIGH, under("__tests__") | path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx|mjs)$")),
        Signal("filename:type-only", "type_only", HIGH, path.endswith(".d.ts")),
        Signal(
            "filename:config", "config", HIGH,
            name.rlike(r"(^|\.)(next|vite|webpack|rollup|tsup|babel|jest|vitest|biome|eslint|prettier|tailwind|postcss)\.config\.(ts|js|mjs|cjs)$")
            | (name == "tsconfig.json") | name.startswith("tsconfig."),
        ),
        Signal("path:routes", "route_handler", MEDIUM, under("routes", "controllers", "handlers")),
        Signal("path:services", "service", MEDIUM, under("services")),
        Signal("path:middleware", "middleware", MEDIUM, under("middleware")),
        Signal("path:hooks", "hook", MEDIUM, under("hooks") | name.rlike(r"^use[A-Z].*\.(ts|tsx)$")),
        Signal("path:components", "component", MEDIUM, under("components") & jsx),
        Signal("path:pages", "page", MEDIUM, under("pages", "app") & jsx),
        Signal("path:scripts", "script", MEDIUM, under("scripts", "bin")),
        Signal("path:seeds", "seed", HIGH, under("seeds?") | path.rlike(r"\.seed\.(ts|js|mjs)$")),
        Signal("path:fixtures", "fixture", HIGH, under("fixtures?")),
        Signal(
            "path:repositories", "repository", MEDIUM,
            under("repositories", "repos", "repo", "dao", "dal", "db") | name.rlike(r"(Repo|Repository|Dao)\.(ts|tsx|js|jsx|mjs|cjs)$"),
        ),
        Signal("import:db-client", "repository", MEDIUM, imports_any("@prisma/client", "drizzle-orm", "typeorm", "mongoose", "kysely")),
        Signal("import:external-client", "client", LOW, imports_any("stripe", "@aws-sdk", "openai", "@anthropic-ai/sdk", "nodemailer")),
    ]
