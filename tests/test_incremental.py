"""An analysis that goes on from the one before gives what a whole one gives, and parses only what changed."""

import pytest
from pyspark.sql import functions as F

from rillstone.plans.analysis import analyse
from rillstone.plans.incremental import IncrementalAnalysis
from rillstone.sources import files as sources

FILES = {
    "a/routes.ts": "import express from 'express';\nimport { one, two } from './service';\nexport function setup(app) {\n  app.get('/x', function first(q) { one(q); });\n  app.post('/y', function second(q) { two(q); });\n}\n",
    "a/service.ts": "import { load } from './db/index';\nexport const one = (x) => load(x);\nexport function two(x) { return local(x); }\nfunction local(x) { return x; }\n",
    "a/db/index.ts": "export function load(x) { return query(x); }\n",
    "b/other.ts": "import { one } from '../a/service';\nexport function far() { return one(1); }\n",
}
CHANGES = {
    "a function calls another one": {"a/service.ts": FILES["a/service.ts"].replace("return local(x)", "return load(x)")},
    "a file comes first and shadows another": {"a/db/index.tsx": "", "a/aa.ts": "export const z = () => 1;\n", "a/db.ts": "export function load() {}\n"},
    "a file takes its place": {"a/db/index.ts": None, "a/db/index.tsx": "export const load = (x) => ask(x);\n"},
    "an entry comes and one goes": {"a/routes.ts": FILES["a/routes.ts"].replace("app.post('/y', function second(q) { two(q); })", "app.put('/y', function third(q) { one(q); two(q); })")},
}


@pytest.fixture(scope="module")
def before(spark):
    found = analyse(sources.given_files(spark, sorted(FILES.items())), "p")
    found.tables()
    return found


@pytest.mark.parametrize("change", CHANGES)
def test_tables_are_those_of_a_whole_run(spark, before, change):
    now = sorted((p, c) for p, c in (FILES | CHANGES[change]).items() if c is not None)
    files = sources.given_files(spark, now)
    found, whole = IncrementalAnalysis(files, "p", before), analyse(files, "p")
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for name, table in whole.tables().items():
        assert rows(getattr(found, name)) == rows(table), name
    parsed = {r["path"] for r in found._parsed.fresh.tokens.select("path").distinct().collect()}
    assert parsed == {p for p, c in CHANGES[change].items() if c}  # an empty file has no tokens
    again = {r["node_identity"].split(":")[-1] for r in found.rewalked.collect()}
    assert again == {
        "a function calls another one": {"second"}, "a file takes its place": {"first"}, "an entry comes and one goes": {"third"},
    }.get(change, set())
    assert found.stale_files.where(F.col("file_path") == "b/other.ts").count() == (1 if change == "a function calls another one" else 0)
