"""JavaScript and TypeScript source parsed by Spark: tokens as rows, structure by windows and joins over each file's tokens.

The lexer cuts files into tokens and pairs their brackets. Functions, variables, methods, imports and exports are then
patterns over tokens of one bracket, found by windows along it, and the functions around a call are an array of nested
spans: a running sum of what begins and ends gives the level of each call, and the innermost span is the last one that
began at this level. All of it takes time in proportion to the tokens of a file, but for the sorting.

Subset: top-level functions, top-level variables set to arrow functions, function expressions or calls, methods of
top-level classes, named function expressions anywhere; ES imports and exports; JSX in all files but TypeScript without
``x``. Where a statement ends without a semicolon is told from the line break and the tokens beside it. ``unbalanced``
names the files whose brackets don't match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.ids import language_of, node_identity, normal_source
from ..functions.lineage import cut
from ..functions.shipping import ship
from .lexer import BEFORE_EXPRESSIONS, GOES_ON, MODIFIERS, SCHEMA, Lexer, has_tags, lex

NAME = r"^#?[\p{L}_$][\p{L}\p{N}_$]*$"
CLOSERS = (")", "]", "}", "`}", "jsx>")
#: After these a function or class is an expression.
EXPRESSION = ("=", "(", "[", ",", "?", ":", "=>", "&&", "||", "??", "!", "~", "+", "-", "...", "${", "<{", *sorted(BEFORE_EXPRESSIONS - {"do", "else", "default", "extends", "of"}))
#: After these a brace opens a type.
TYPES = (":", "|", "&", "=>", "is", "keyof", "extends", "readonly")
#: Words that are no operand of a chain of members and calls.
NOT_OPERANDS = ("await", "async", "function", "typeof", "void", "delete", "yield", "class", "new", "in", "of", "instanceof", "as", "satisfies")


def tokens(files: DataFrame) -> DataFrame:
    """A row for each token that is neither comment nor white space, as ``lexer.Lexer`` describes it."""
    ship(files.sparkSession)
    return files.select("path", "file_ord", "content").mapInArrow(lex, SCHEMA)


def register_tokens(spark: SparkSession, name: str = "source_tokens") -> None:
    """Registers the lexer as a table function of SQL: ``SELECT * FROM source_tokens(TABLE(files) PARTITION BY path)`` reads path, file_ord and content."""

    class Tokens:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable or not {"path", "file_ord", "content"} <= {f.name for f in files.dataType.fields}:
                raise ValueError("a table with path, file_ord and content is needed")
            kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
            return AnalyzeResult(T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))]))

        def eval(self, files: Row) -> Iterator[tuple]:
            columns = Lexer(files["content"] or "", has_tags(files["path"])).columns()
            names = [f.split()[0] for f in SCHEMA.split(", ")][2:]
            for values in zip(*(columns[c] for c in names), strict=True):
                yield files["path"], files["file_ord"], *values

    ship(spark)
    spark.udtf.register(name, udtf(Tokens))


def _around(toks: DataFrame, back: int = 4, ahead: int = 8) -> DataFrame:
    """Tokens with their neighbours as b1, b2, … and a1, a2, …; of a literal, which can be long, a neighbour sees the quote."""
    order = W.partitionBy("path").orderBy("ord")
    short = F.when(F.col("t").startswith("'") | F.col("t").startswith('"'), F.left("t", F.lit(1))).otherwise(F.col("t"))
    near = {f"b{k}": F.lag(short, k).over(order) for k in range(1, back + 1)} | {f"a{k}": F.lead(short, k).over(order) for k in range(1, ahead + 1)}
    return toks.withColumns(near)


def unbalanced(files: DataFrame) -> DataFrame:
    brackets = ("(", "[", "{", "`{", "${", "<jsx", "<{", *CLOSERS)
    return tokens(files).where(F.col("t").isin(*brackets) & F.col("pair").isNull()).select("path").distinct()


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _spot(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


#: What is known of a symbol: its place among others of its name, where it stands, and where its parameters and the type of its result do.
_SYMBOL = (
    "path", "symbol", "exported", "rank", "start_ord", "start_place", "start_line", "end_ord", "end_place", "end_line",
    "signed", "lone", "params_ord", "params_place", "params_end", "type_end", "name_place", "name_end",
)


def _symbol(df: DataFrame, **fields: Column | str) -> DataFrame:
    """Rows of symbols. ``start``, ``end``: tokens; ``params``: the opening bracket of parameters; others as they are called."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}
    start, end, params = given.pop("start"), given.pop("end"), given.pop("params")
    given |= {f"start_{k}": start[k] for k in ("ord", "place", "line")} | {"end_ord": F.coalesce(end["pair"], end["ord"]), "end_place": end["end_place"], "end_line": end["end_line"]}
    given |= {"params_ord": params["ord"], "params_place": params["place"], "params_end": params["end_place"]}
    unknown = {"lone": "string", "name_place": "int", "name_end": "int"}
    given = {k: F.lit(None).cast(kind) for k, kind in unknown.items() if k not in df.columns} | given
    return df.select(*[given[c].alias(c) if c in given else F.col(c) for c in _SYMBOL])


_TOKEN = ("ord", "t", "angle", "pair", "place", "end_place", "line", "end_line", "decorator")


def _functions(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions that are declared at the top or are named expressions, and classes at the top with their braces."""
    token = F.struct(*_TOKEN)
    # the nearest later tokens of the bracket that a token stands in
    later = W.partitionBy("path", "within").orderBy(F.col("ord").desc()).rowsBetween(W.unboundedPreceding, -1)
    nearest = lambda condition: F.last(F.when(condition, token), ignorenulls=True).over(later)
    flat, brace = F.col("angle") == 0, F.col("t") == "{"
    ends = F.col("t").isin(";", "function", "class", "export", "import")
    ahead = near.withColumns({"params": nearest(flat & (F.col("t") == "(")), "body": nearest(flat & brace & ~_none(F.col("b1").isin(*TYPES))), "halt": nearest(ends)})
    modifier = lambda c: F.when(_none(F.col(c[0]) == c[1]), 1).otherwise(0)
    own = ahead.where(F.col("t").isin("function", "class") & ~_none(F.col("b1").isin(".", "?.")))
    led = F.when(F.col("t") == "function", modifier(("b1", "async"))).otherwise(modifier(("b1", "abstract")))
    own = own.withColumn("led", led).withColumn("before", F.when(F.col("led") == 1, F.col("b2")).otherwise(F.col("b1"))).withColumn("before2", F.when(F.col("led") == 1, F.col("b3")).otherwise(F.col("b2")))
    own = own.withColumn("first_stop", F.when(F.col("led") == 1, F.col("b1_stop")).otherwise(F.col("stop")))
    expression = _none(F.col("before").isin(*EXPRESSION)) & ~_none(F.col("first_stop"))
    name = F.when(F.col("a1").rlike(NAME) & ~F.col("a1").isin("extends", "implements"), F.col("a1")).when((F.col("a1") == "*") & F.col("a2").rlike(NAME), F.col("a2"))
    default = _none(F.col("before") == "default")
    marked = default.cast("int") + _none(F.col("before").isin("export", "declare") | (default & (F.col("before2") == "export"))).cast("int")
    own = own.withColumns({
        "expression": expression, "own_name": name, "top": (F.col("depth") == 0) & ~expression, "exported": default | _none(F.col("before") == "export"),
        "first_ord": (F.col("ord") - F.col("led") - F.when(expression, 0).otherwise(marked)).cast("int"),
    })
    there = F.col("body").isNotNull() & (F.col("halt").isNull() | (F.col("halt.ord") > F.col("body.ord")))
    firsts = near.select("path", F.col("ord").alias("first_ord"), _spot(ord="ord", place="place", line="line").alias("start"))
    wanted = own.where(there & (F.col("t") == "function") & (F.col("top") | (F.col("expression") & F.col("own_name").isNotNull()))).join(firsts, ["path", "first_ord"])
    functions = _symbol(
        wanted, symbol=F.coalesce("own_name", F.lit("<anonymous>")), exported=F.col("exported") & F.col("top"), rank=F.when(F.col("top"), 0).otherwise(3), start="start", end="body",
        signed=F.lit(True), params="params", type_end=F.col("body.place"),
    )
    classes = own.where(there & (F.col("t") == "class") & F.col("top") & F.col("own_name").isNotNull()).select("path", F.col("own_name").alias("holder"), F.col("body.ord").alias("within"))
    return functions, classes


def _methods(near: DataFrame, classes: DataFrame) -> DataFrame:
    """Methods of classes, without constructors and accessors: a name and a bracket after modifiers alone, with a body."""
    held = near.where(~F.col("t").isin(*CLOSERS)).join(classes, ["path", "within"])
    order = W.partitionBy("path", "within").orderBy("ord")
    before, t = F.lag("t").over(order), F.col("t")
    after_body = (before == "{") & (~t.isin(*sorted(GOES_ON)) | (t == "*") | ((t == "[") & F.col("fresh")))
    begins = before.isNull() | (before == ";") | after_body | (F.col("stop") & ~_none(F.lag("decorator").over(order)))
    members = held.withColumn("nth", F.sum(F.when(begins, 1).otherwise(0)).over(order)).groupBy("path", "within", "holder", "nth").agg(F.sort_array(F.collect_list(F.struct(*_TOKEN))).alias("every"))
    items = F.filter("every", lambda x: ~x["decorator"] & (x["angle"] == 0) & (x["t"] != ";"))
    at = F.array_position(F.transform("items", lambda x: x["t"]), "(").cast("int")  # from 1
    members = members.withColumn("items", items).withColumn("at", at).where(F.col("at") > 1)
    members = members.withColumn("name_at", F.when(F.get("items", F.col("at") - 2)["t"] == "?", F.col("at") - 2).otherwise(F.col("at") - 1)).where(F.col("name_at") > 0)
    bodies = F.filter(F.sequence(F.col("at"), F.size("items")), lambda j: (F.get("items", j)["t"] == "{") & ~F.get("items", j - 1)["t"].isin(*TYPES))
    members = members.withColumns({"own": F.get("items", F.col("name_at") - 1), "mods": F.transform(F.slice("items", F.lit(1), F.greatest(F.col("name_at") - 1, F.lit(0))), lambda x: x["t"]), "body": F.get("items", F.get(bodies, F.lit(0)))})
    own = F.col("own.t")
    plain = F.forall("mods", lambda m: m.isin(*sorted(MODIFIERS), "*")) & ~F.arrays_overlap("mods", F.array(F.lit("get"), F.lit("set"))) & (own != "constructor") & (own.rlike(NAME) | own.rlike(r"^['\"\[0-9]"))
    last = F.element_at("items", -1)
    found = members.where(plain & (F.col("body").isNotNull() | F.array_contains("mods", "abstract"))).withColumns({"first": F.get("every", F.lit(0)), "params": F.get("items", F.col("at") - 1), "end": F.coalesce("body", last)})
    return _symbol(
        found, symbol=F.concat_ws(".", "holder", own), exported=F.lit(False), rank=F.lit(2), start="first", end="end", signed=F.lit(True), params="params", type_end=F.coalesce("body.place", last["end_place"]),
        name_place=F.when(own == "[", F.col("own.place")), name_end=F.when(own == "[", F.col("own.end_place")),
    )


def _declarators(near: DataFrame) -> DataFrame:
    """Each variable that a statement at the top declares: its tokens outside brackets, and whether it is exported."""
    flat = near.where((F.col("depth") == 0) & ~F.col("t").isin(*CLOSERS))
    order = W.partitionBy("path").orderBy("ord")
    begins = F.col("t").isin("const", "let", "var") & ~_none(F.col("b1").isin(".", "?.")) & ~_none(F.col("a1") == "enum")
    halts = begins | F.col("stop") | F.col("t").isin(";", "export", "import", "class") | ((F.col("t") == "function") & ~_none(F.col("b1").isin(*EXPRESSION, "async")))
    exported = begins & _none((F.col("b1") == "export") | ((F.col("b1") == "declare") & (F.col("b2") == "export")))
    cut_up = flat.withColumns({"begins": begins, "exported": exported, "nth": F.sum(F.when(halts, 1).otherwise(0)).over(order)})
    inside = W.partitionBy("path", "nth").orderBy("ord")
    comma = (F.col("t") == ",") & (F.col("angle") == 0)
    listed = cut_up.withColumns({"declares": F.first("begins").over(inside), "exported": F.first("exported").over(inside), "i": F.sum(F.when(comma, 1).otherwise(0)).over(inside)})
    rows = listed.where(F.col("declares") & ~F.col("begins") & ~comma & (F.col("t") != ";"))
    return rows.groupBy("path", "nth", "i", "exported").agg(F.sort_array(F.collect_list(F.struct(*_TOKEN))).alias("every")).withColumn("own", F.get("every", F.lit(0)))


def _variables(declared: DataFrame) -> DataFrame:
    """Variables whose value, as a whole, is an arrow function, a function expression or a call."""
    flat = F.filter("every", lambda x: x["angle"] == 0)
    names = lambda c: F.transform(c, lambda x: x["t"])
    kind = lambda x: F.when(x["t"].rlike(NAME) & ~x["t"].isin(*NOT_OPERANDS), "n").when(x["t"].rlike(r"^['\"0-9]|^\.[0-9]"), "s").otherwise(x["t"])
    rows = declared.withColumn("flat", flat).withColumn("at", F.array_position(names("flat"), "=").cast("int")).where(F.col("at") > 0)
    rows = rows.withColumn("value", F.slice("flat", F.col("at") + 1, F.size("flat"))).where(F.size("value") > 0).withColumn("kinds", F.transform("value", kind))
    head = F.concat_ws(" ", F.slice("kinds", 1, 3))
    k = lambda i: F.get("kinds", i)
    begins = F.when(k(F.lit(0)) == "async", 1).otherwise(0)
    last, arrow = F.element_at("kinds", -1), F.array_position("kinds", "=>").cast("int")  # from 1
    # a bracket or one name, then an arrow; between bracket and arrow only a type
    is_arrow = (arrow > 0) & (((k(begins) == "(") & ((arrow == begins + 2) | (k(begins + 1) == ":"))) | ((k(begins) == "n") & (arrow == begins + 2)))
    is_function = head.rlike("^(async )?function( |$)") & (last == "{")
    # a chain of members and calls that ends in a call; one that begins with ``new`` needs a call after that of the constructor
    made = k(F.lit(0)) == "new"
    linked = F.forall(
        F.sequence(F.lit(1), F.size("kinds") - 1),
        lambda i: k(i).isin(".", "?.", "(", "[", "`", "`{", "!") | ((k(i) == "n") & (k(i - 1).isin(".", "?.") | (k(i - 1) == "new"))) | (k(i).rlike(r"^[\p{L}_$]") & k(i - 1).isin(".", "?.")),
    )
    calls = F.size(F.filter("kinds", lambda x: x == "("))
    is_call = (F.size("kinds") > 1) & (last == "(") & (k(F.lit(0)).isin("n", "s", "(", "[", "{", "`", "`{", "/", "<jsx", "new") | head.rlike("^function ")) & (linked | head.rlike("^function ")) & (~made | (calls > 1))
    shape = F.when(is_arrow, "arrow").when(is_function, "function").when(is_call, "call")
    found = rows.withColumns({"shape": shape, "lone": F.when(is_arrow & (k(begins) == "n"), F.get("value", begins)["t"]), "last": F.element_at("every", -1)}).where(F.col("shape").isNotNull())
    params = F.when((F.col("shape") != "call") & F.col("lone").isNull(), F.get("value", F.array_position("kinds", "(").cast("int") - 1))
    type_end = F.when(F.col("shape") == "arrow", F.get("value", arrow - 1)["place"]).when(F.col("shape") == "function", F.element_at("value", -1)["place"])
    pattern = F.col("own.t").isin("{", "[")
    return _symbol(
        found.withColumns({"params": params, "type_end": type_end}), symbol=F.col("own.t"), rank=F.lit(1), start="own", end="last", signed=F.col("shape") != "call", params="params",
        name_place=F.when(pattern, F.col("own.place")), name_end=F.when(pattern, F.col("own.end_place")),
    )


def _near(toks: DataFrame) -> DataFrame:
    return _around(toks, 3, 2).withColumn("b1_stop", F.lag("stop").over(W.partitionBy("path").orderBy("ord")))


def _spots(toks: DataFrame, declared: DataFrame) -> DataFrame:
    """Where the functions of each file stand.

    ``rank`` is the order in which symbols of one name take its place: functions, variables, methods, function expressions.
    """
    near = _near(toks)
    functions, classes = _functions(near)
    return functions.unionByName(_methods(near, classes)).unionByName(_variables(declared))


def _short_name() -> Column:
    return F.when(F.col("rank") == 2, F.regexp_extract("symbol", r"(?s)([^.]*)$", 1)).otherwise(F.col("symbol")).alias("name")


def _spans(spots: DataFrame, project: Column) -> DataFrame:
    """What calls need of symbols, if no name is a part of the content."""
    return spots.where(F.col("path").isNotNull()).select(
        node_identity(project, F.col("path"), F.col("symbol")).alias("node_identity"), F.col("path").alias("file_path"), F.col("start_ord").alias("node_ord"), F.col("end_ord").alias("close_ord"), _short_name(), "rank"
    )


def _symbols(every: DataFrame, toks: DataFrame, files: DataFrame, project: Column) -> DataFrame:
    """Functions of each file, from their spots, with their texts' hashes and signatures.

    A file's symbols meet its content in one row, so that it is not copied for each of them, nor sorted.
    """
    commas = toks.where((F.col("t") == ",") & (F.col("angle") == 0)).select("path", F.col("within").alias("params_ord"), "place")
    listed = commas.join(every.select("path", "params_ord").distinct(), ["path", "params_ord"]).groupBy("path", "params_ord").agg(F.sort_array(F.collect_list("place")).alias("commas"))
    per_file = every.join(listed, ["path", "params_ord"], "left").groupBy("path").agg(F.collect_list(F.struct(*[c for c in _SYMBOL if c != "path"], "commas")).alias("symbols"))
    between = lambda low, high: F.substr("content", low + 1, high - low)
    stripped = lambda text: F.regexp_replace(text, r"(?U)^\s+|\s+$", "")

    def told(s: Column) -> Column:
        text = between(s["start_place"], s["end_place"])
        bounds = F.concat(F.array(s["params_place"]), F.coalesce(s["commas"], F.array().cast("array<int>")), F.array(s["params_end"] - 1))
        params = F.filter(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: stripped(between(F.get(bounds, i) + 1, F.get(bounds, i + 1)))), lambda p: p != "")
        result = stripped(between(s["params_end"], s["type_end"]))
        lone = s["lone"].isNotNull()
        signature = F.struct(
            F.when(lone, F.array(s["lone"])).when(s["params_ord"].isNull(), F.array().cast("array<string>")).otherwise(params).alias("params"),
            F.when(lone | ~result.startswith(":"), "").otherwise(stripped(F.regexp_replace(result, r"^:|;$", ""))).alias("return_type"),
        )
        named = F.when(s["name_place"].isNotNull(), F.concat(F.regexp_replace(s["symbol"], r"[\[{]$", ""), between(s["name_place"], s["name_end"]))).otherwise(s["symbol"])
        component = named.rlike("^[A-Z]") & (F.contains(text, F.lit("</")) | F.contains(text, F.lit("/>")) | F.contains(text, F.lit("React.createElement")))
        return F.struct(
            named.alias("symbol"), F.when((s["rank"] == 1) & component, "component").otherwise("function").alias("kind"), s["exported"].alias("exported"), s["rank"].alias("rank"),
            s["start_ord"].alias("node_ord"), s["end_ord"].alias("close_ord"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
            F.sha2(normal_source(text), 256).alias("content_hash"), F.when(s["signed"], signature).alias("signature"),
        )

    found = files.select("path", "file_ord", "content").join(per_file.hint("shuffle_hash"), "path").select("path", "file_ord", F.explode(F.transform("symbols", told)).alias("s")).select("path", "file_ord", "s.*")
    return found.select(
        node_identity(project, F.col("path"), F.col("symbol")).alias("node_identity"), F.col("path").alias("file_path"), "file_ord", "node_ord", "kind",
        _short_name(),
        "start_line", "end_line", "exported", "content_hash", "symbol", "close_ord", "rank", "signature",
    )


def _statements(toks: DataFrame, word: str, ends: Column) -> DataFrame:
    """Statements at the top that begin with a word: where they begin, and their text as tokens with blanks between, to the first token that ends them."""
    starts = (F.col("t") == word) & (F.col("depth") == 0)
    order = W.partitionBy("path").orderBy("ord")
    own = toks.where(F.col("depth") <= 1).select("path", "ord", "t", "depth").withColumn("b1", F.lag("t").over(order)).withColumn("at", F.last(F.when(starts & ~F.coalesce(F.col("b1") == ".", F.lit(False)), F.col("ord")), ignorenulls=True).over(order)).where(F.col("at").isNotNull())
    stops = own.where((F.col("ord") > F.col("at")) & ends).groupBy("path", "at").agg(F.min_by(F.struct("ord", "t"), "ord").alias("stop"))
    held = own.join(stops, ["path", "at"]).where((F.col("ord") > F.col("at")) & (F.col("ord") <= F.col("stop.ord")))
    return held.groupBy("path", "at", F.col("stop.t").alias("last")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda z: z["t"]), " ").alias("clause"))


def _names(listed: Column) -> Column:
    """The parts of a list of names as its tokens stand, without ``type`` before them."""
    parts = F.filter(F.split(listed, " ?, ?"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"^type (?!as\b)", ""))


def _imports(toks: DataFrame) -> DataFrame:
    """A row for each name that a file imports, under the name that the other file gives it, in the order named, default, whole."""
    quoted = F.col("t").rlike("^['\"]")
    found = _statements(toks, "import", quoted | F.col("t").isin(";", "(")).where(F.col("last").rlike("^['\"]"))
    clause = F.regexp_replace(F.regexp_replace("clause", r" ?(from )?\S*$", ""), r"^type (?=[{*\p{L}_$])(?!from\b)", "")
    named = F.transform(_names(F.regexp_extract("c", r"\{([^}]*)\}", 1)), lambda x: F.regexp_replace(x, r" as .*$", ""))
    none = F.array().cast("array<string>")
    default = F.when(F.col("c").rlike(r"^[\p{L}_$]"), F.array(F.lit("default"))).otherwise(none)
    whole = F.when(F.col("c").rlike(r"\* as "), F.array(F.lit("*"))).otherwise(none)
    rows = found.withColumn("c", clause).select("path", "at", F.expr("substring(last, 2, length(last) - 2)").alias("module"), F.posexplode_outer(F.concat(named, default, whole)).alias("k", "specifier"))
    return rows.select(F.col("path").alias("file_path"), (F.col("at") + F.coalesce("k", F.lit(0))).cast("int").alias("import_ord"), "module", "specifier")


def _by_name(symbols: DataFrame) -> DataFrame:
    """The symbol that a name means in its file: the last, as functions, variables, methods and function expressions follow each other."""
    return symbols.groupBy(F.col("file_path").alias("path"), F.col("name").alias("t")).agg(F.max_by("node_identity", F.struct("rank", "node_ord")).alias("known"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (path, at, …) with ``holder``, the value of the innermost span (path, low, high, value) around them; points in none are left out.

    Spans of a path are nested or apart. What begins and ends along a path gives the level of each point; the span
    around it is the last that began at that level.
    """
    rest = [c for c in points.columns if c not in ("path", "at")]
    point = points.select("path", "at", F.lit(1).alias("turn"), F.lit(0).alias("step"), F.lit(0).alias("order"), F.struct(*rest).alias("p"), F.lit(None).cast("string").alias("value"))
    kind = point.schema["p"].dataType
    begin = spans.select("path", F.col("low").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("step"), (-F.col("high")).alias("order"), F.lit(None).cast(kind).alias("p"), "value")
    end = spans.select("path", F.col("high").alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("step"), F.lit(0).alias("order"), F.lit(None).cast(kind).alias("p"), F.lit(None).cast("string").alias("value"))
    along = W.partitionBy("path").orderBy("at", "turn", "order")
    # an end counts for what comes after it
    level = F.sum("step").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    events = begin.unionByName(point).unionByName(end).withColumn("level", level)
    last = F.last(F.when(F.col("turn") == 0, F.col("value")), ignorenulls=True).over(W.partitionBy("path", "level").orderBy("at", "turn", "order").rowsBetween(W.unboundedPreceding, W.currentRow))
    return events.withColumn("holder", last).where((F.col("turn") == 1) & (F.col("level") > 0)).select("path", "at", "p.*", "holder")


def _calls(toks: DataFrame, symbols: DataFrame, project: Column) -> DataFrame:
    """Calls inside functions, an outer one before those that it holds; and named function expressions that a call is given first of all functions, as edges to what is called."""
    called = toks.where(F.col("callee").isNotNull()).select("path", "file_ord", "ord", F.col("head").alias("at"), F.when(F.col("callee") != ")", F.col("callee")).alias("t"), F.col("head_line").alias("line"), F.col("head_col").alias("col"))
    spans = symbols.select(F.col("file_path").alias("path"), F.col("node_ord").alias("low"), F.col("close_ord").alias("high"), F.col("node_identity").alias("value"))
    inner = innermost(called, spans).withColumnRenamed("holder", "caller")
    rows = inner.join(_by_name(symbols), ["path", "t"], "left").withColumn("same", F.col("known").isNotNull() & (F.col("known") != F.col("caller")))
    near = _around(toks, 2, 1)
    function = (F.col("t") == "function") & F.col("b1").isin("(", ",", "async")
    given = near.where((function | (F.col("t") == "=>")) & F.col("within").isNotNull())
    first = given.groupBy("path", F.col("within").alias("ord")).agg(F.min_by(F.when(function & F.col("a1").rlike(NAME), F.col("a1")), "ord").alias("handler")).where(F.col("handler").isNotNull())
    attached = called.where(F.col("t").isNotNull()).join(first, ["path", "ord"])
    make = lambda df, caller, callee, unresolved, hint, turn: df.select(
        F.col("path").alias("file_path"), "file_ord", "at", "ord", F.lit(turn).alias("turn"), caller.alias("caller"), callee.alias("callee"), "line", "col", unresolved.alias("unresolved"), hint.alias("hint")
    )
    named = lambda c: node_identity(project, F.col("path"), F.col(c))
    inside = make(
        rows, F.col("caller"), F.when(F.col("same"), F.col("known")).when(F.col("t").isNotNull(), named("t")), ~F.col("same"),
        F.when(F.col("t").isNull(), "indirect").when(~F.col("same"), "cross-file-or-external"), 0,
    )
    both = inside.unionByName(make(attached, named("handler"), named("t"), F.lit(True), F.lit("handler-attached"), 1))
    seq = F.row_number().over(W.partitionBy("file_path").orderBy("at", F.desc("ord"), "turn")) - 1
    return both.select("file_path", "file_ord", seq.alias("edge_seq"), "caller", "callee", "line", "col", "unresolved", "hint")


def _exports(toks: DataFrame, declared: DataFrame) -> DataFrame:
    """A row for each exported name, with the name inside the file that it is given to."""
    near = _around(toks, 1, 3)
    at = near.where((F.col("t") == "export") & (F.col("depth") == 0) & ~F.coalesce(F.col("b1").isin(".", "?."), F.lit(False)))
    spot = F.when(F.col("a1").isin("async", "abstract", "declare"), F.when(F.col("a3") == "*", None).otherwise(F.col("a3"))).when(
        F.col("a1").isin("function", "class", "interface", "type", "enum", "namespace"), F.when(F.col("a2") == "*", F.col("a3")).otherwise(F.col("a2"))
    )
    name = F.when(F.col("a1") == "default", "default").when(spot.rlike(NAME), spot)
    inner = F.when((F.col("a1") == "default") & F.col("a2").rlike(NAME) & ~F.col("a2").isin("function", "class", "async", "new", "await"), F.col("a2")).when(name != "default", name)
    direct = at.select(F.col("path").alias("file_path"), F.col("ord").alias("export_ord"), name.alias("name"), inner.alias("inner")).where(F.col("name").isNotNull())
    lists = _statements(toks, "export", F.col("t").isin("}", ";", "=", "(")).where((F.col("last") == "}") & F.col("clause").rlike(r"^(type )?\{"))
    each = lists.select("path", "at", F.posexplode(_names(F.regexp_extract("clause", r"\{([^}]*)\}", 1))).alias("k", "n"))
    named = each.select(F.col("path").alias("file_path"), (F.col("at") + 1 + F.col("k")).cast("int").alias("export_ord"), F.regexp_replace("n", r"^.* as ", "").alias("name"), F.regexp_replace("n", r" as .*$", "").alias("inner"))
    # variables by their names, or by the names in a pattern
    variables = declared.where("exported")
    plain = variables.where(F.col("own.t").rlike(NAME)).select(F.col("path").alias("file_path"), F.col("own.ord").alias("export_ord"), F.col("own.t").alias("name"), F.col("own.t").alias("inner"))
    patterns = variables.where(F.col("own.t").isin("{", "[")).select("path", F.col("own.ord").alias("within"))
    bound = near.where(F.col("t").rlike(NAME) & F.col("a1").isin(",", "}", "]", "=")).join(patterns, ["path", "within"]).select(F.col("path").alias("file_path"), F.col("ord").alias("export_ord"), F.col("t").alias("name"), F.col("t").alias("inner"))
    return direct.unionByName(named).unionByName(plain).unionByName(bound)


class Parsed:
    """Five tables of files (file_ord, path, content): ``files``, ``nodes``, ``imports``, ``exports`` and ``call_edges``.

    Each is made when it is first asked for, once for this object; what several of them are made from is written on the way.
    """

    def __init__(self, files: DataFrame, project: str) -> None:
        self._files, self._project = files, F.lit(project)

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens; of a string inside two brackets, which can be long and names nothing, the quote alone."""
        deep = (F.col("depth") > 1) & (F.col("t").startswith("'") | F.col("t").startswith('"'))
        return cut(tokens(self._files).withColumn("t", F.when(deep, F.left("t", F.lit(1))).otherwise(F.col("t"))))

    @cached_property
    def _declared(self) -> DataFrame:
        return cut(_declarators(_near(self.tokens)))

    @cached_property
    def _spots(self) -> DataFrame:
        return cut(_spots(self.tokens, self._declared))

    @property
    def _spans(self) -> DataFrame:
        """What calls need of symbols. Contents are read again only for the names of patterns and computed members."""
        if "symbols" in self.__dict__ or not self._spots.where(F.col("name_place").isNotNull()).isEmpty():
            return self.symbols
        return _spans(self._spots, self._project)

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(_symbols(self._spots, self.tokens, self._files, self._project))

    @cached_property
    def _named(self) -> DataFrame:
        return cut(_exports(self.tokens, self._declared))

    @property
    def files(self) -> DataFrame:
        return self._files.select("path", F.sha2("content", 256).alias("content_hash"), language_of(F.col("path")).alias("language"))

    @cached_property
    def nodes(self) -> DataFrame:
        listed = self._named.where(F.col("inner").isNotNull()).select("file_path", F.col("inner").alias("symbol")).distinct().withColumn("_listed", F.lit(True))
        exported = F.coalesce("_listed", F.lit(False)) & (F.col("rank") < 2) | F.col("exported")
        return self.symbols.join(listed, ["file_path", "symbol"], "left").select(
            "node_identity", "file_path", "file_ord", "node_ord", "kind", "name", "start_line", "end_line", exported.alias("exported"), "content_hash", "signature"
        )

    @cached_property
    def imports(self) -> DataFrame:
        return cut(_imports(self.tokens))

    @cached_property
    def exports(self) -> DataFrame:
        means = _by_name(self.symbols).select(F.col("path").alias("file_path"), F.col("t").alias("name"), F.col("known").alias("node_identity"))
        return self._named.join(means, ["file_path", "name"], "left").select("file_path", "export_ord", "name", "node_identity")

    @cached_property
    def call_edges(self) -> DataFrame:
        return cut(_calls(self.tokens, self._spans, self._project))


def parse(files: DataFrame, project: str) -> Parsed:
    return Parsed(files, project)
