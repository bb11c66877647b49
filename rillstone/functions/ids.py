"""Identities, paths, names and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source file endings in the order in which a module path without one is looked up.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".cts", ".mts")


def node_identity(project: Column, path: Column, symbol: Column) -> Column:
    return F.concat_ws(":", project, path, symbol)


def last_segment(identity: Column) -> Column:
    """What follows the last colon; the whole text if there is none."""
    return F.substring_index(identity, ":", -1)


def symbol_of(identity: Column) -> Column:
    """The symbol of an identity of at least three parts, else null."""
    return F.when(F.size(F.split(identity, ":")) >= 3, last_segment(identity))


def without_first_segment(identity: Column) -> Column:
    at = F.instr(identity, ":")
    return F.when(at == 0, F.lit("")).otherwise(F.substr(identity, at + 1))


def identity_parts(identity: Column) -> Column:
    """Struct (project, path, symbol) split at the first and the last colon; null with fewer than two colons."""
    first = F.instr(identity, ":")
    symbol = last_segment(identity)
    path = F.substr(identity, first + 1, F.length(identity) - first - F.length(symbol) - 1)
    colons = F.length(identity) - F.length(F.replace(identity, F.lit(":"), F.lit("")))
    return F.when(colons >= 2, F.struct(F.substring_index(identity, ":", 1).alias("project"), path.alias("path"), symbol.alias("symbol")))


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def normal_path(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved; ``..`` above the top vanishes."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def joined_path(folder: Column, relative: Column) -> Column:
    return normal_path(F.concat_ws("/", folder, relative))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def category_of(identity: Column) -> Column:
    """Struct (category, category_order) from the file name in an identity."""
    path = F.coalesce(F.get(F.split(identity, ":"), F.lit(1)), F.lit(""))
    name = F.regexp_replace(base_name(path), r"\.[^.]+$", "")
    category = F.when(name == "", F.lit("other")).otherwise(name)
    return F.struct(category.alias("category"), F.when(category == "other", 999).otherwise(F.ascii(category)).cast("int").alias("category_order"))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in order of their names, nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def codebase_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name, cut before capitals and at underscores, blanks, hyphens and dots."""
    cut = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(cut, r"[_\s\-.]+"), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 where there is none."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both).cast("double")


def name_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(token_similarity(name_tokens(a), name_tokens(b)))


def cut_off(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters and a note of how many are left out."""
    left = F.length(text) - most
    return F.when(left > 0, F.concat(F.substring(text, 1, most), F.lit("\n…[truncated "), left.cast("string"), F.lit(" chars]"))).otherwise(text)


def unfenced(text: Column) -> Column:
    """The text inside a code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(text)


def parsed_response(text: Column, schema: str, required: list[str]) -> Column:
    """The JSON in a response, fenced or not, as a struct; null if it can't be read or lacks a required field."""
    found = F.from_json(F.trim(unfenced(F.trim(text))), schema, {"mode": "PERMISSIVE"})
    there = F.lit(True)
    for field in required:
        there = there & found[field].isNotNull()
    return F.when(there, found)


def iso_time(at: Column) -> Column:
    """A time in UTC as text with milliseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def percent(share: Column) -> Column:
    """A share as a whole percentage."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def short_id(identity: Column) -> Column:
    return F.substring(identity, 1, 8)


def scope_key(kind: Column, path_id: Column) -> Column:
    return F.when(kind == "path", F.concat(F.lit("path:"), path_id)).otherwise(F.lit("global"))


def scope_parts(scope: Column) -> Column:
    named = scope.startswith("path:")
    return F.struct(F.when(named, F.lit("path")).otherwise(F.lit("global")).alias("kind"), F.when(named, F.substr(scope, F.lit(6))).alias("path_id"))


def body_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, as far as the content has them."""
    low = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(content, "\n"), low, F.greatest(end - low + 1, F.lit(0))), "\n")


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".tsx"), "tsx").when(path.endswith(".ts"), "typescript").when(path.endswith(".jsx"), "jsx").otherwise("javascript")


def normal_source(text: Column) -> Column:
    """Source without comments (line comments go first, even inside strings) and with white space as single blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")
