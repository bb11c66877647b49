"""Quality rules by line-first cleaning.

Each line is judged alone by rules on punctuation (signs, exclamation marks, a
long line without a closing mark), navigation and boilerplate. Lines that fail are
removed; a document that loses too large a share of its characters, or that fails
the base rules on length and repetition, is rejected.

Defined results: null text counts as empty; an empty text has no words, so the
base rule on length rejects it; blank lines are neither judged nor counted; texts
of any length are judged whole; repeated rows are judged each for itself, so there
are no ties; an empty table gives an empty one. Further columns pass through; one
that has the name of an output is replaced, unless ``prefix`` sets the outputs apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, shingles, unused, words

#: Marks that prose seldom uses, signs that part the entries of menus, marks that can close a line of prose, and phrases of boilerplate lines in lower case.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
CLOSING = ".!?:;,\"')]}»”’…。！？：；，」』）؟۔।॥"
BOILERPLATE = (
    "rights reserved", "copyright (c)", "©", "licensed under", "released under the", "public license", "cookie policy", "use cookies", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "click here", "subscribe to our", "sign up for our", "follow us on", "share this article",
    "skip to content", "skip to main content", "enable javascript", "javascript is disabled", "powered by wordpress", "lorem ipsum",
)
#: What the outputs of ``apply_quality_rules`` are called.
OUTPUTS = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars", "n_lines", "n_failed_lines", "base_failed", "kept")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Shares are of the characters of a line, or of all lines."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 8
    max_exclaim_percent: int = 7
    min_separators: int = 3
    max_open_chars: int = 60
    max_lost_percent: int = 30


def _any_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE]))


def _long_and_open(line: Column, rules: QualityRules) -> Column:
    """Is the line longer than prose may be without a closing mark at its end?"""
    last = F.substring(F.rtrim(line, F.lit(" \t\x0b\x0c\r")), -1, 1)
    return (F.length(line) > rules.max_open_chars) & ~F.contains(F.lit(CLOSING), last)


def line_fails(line: Column, rules: QualityRules = QualityRules()) -> Column:
    """True if a rule on punctuation, navigation or boilerplate removes this line."""
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    exclaims = F.length(F.regexp_replace(line, "[^!]+", ""))
    separators = F.size(F.split(line, f" [{SEPARATORS}] ")) - 1
    return (
        _long_and_open(line, rules)
        | (symbols * 100 > F.length(line) * rules.max_symbol_percent)
        | (exclaims * 100 > F.length(line) * rules.max_exclaim_percent)
        | (separators >= rules.min_separators)
        | _any_phrase(line)
    )


def may_fail(text: Column, lines: Column, symbols: Column, rules: QualityRules = QualityRules()) -> Column:
    """False if no line of the text can fail, since nothing that the rules look for is in it. ``symbols``: their number in it."""
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in "!" + SEPARATORS])
    return (symbols > 0) | marked | _any_phrase(text) | F.exists(lines, lambda x: _long_and_open(x, rules))


def repeated_words(hashes: Column, few: int = 64) -> Column:
    """How many words lie in a run of three words that a text holds twice or more, from the hashes of its words.

    Most texts repeat no run, as a hash set tells. Otherwise the sorted hashes give
    the repeated runs; their places are found by looking every run up among them, or,
    where they are more than ``few``, by sorting the runs with their places.
    The places then cover up to three words each, overlaps counted once.
    """
    twice = lambda runs: let(F.sort_array(runs), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1).eqNullSafe(x))))
    among = lambda runs, some: F.filter(F.transform(runs, lambda x, i: F.when(F.array_contains(some, x), i)), lambda i: i.isNotNull())
    placed = lambda runs: F.sort_array(F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, k, x: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
    sorted_ = lambda runs: let(placed(runs), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, k, x)), lambda x: x["i"])))
    places = lambda runs: let(twice(runs), lambda some: F.when(F.size(some) <= few, among(runs, some)).otherwise(sorted_(runs)))
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return let(
        shingles(hashes, 3),
        lambda runs: F.when(F.size(F.array_distinct(runs)) < F.size(runs), let(places(runs), covered)).otherwise(F.lit(0)),
    )


def apply_quality_rules(df: DataFrame, text: str = "text", rules: QualityRules = QualityRules(), prefix: str = "") -> DataFrame:
    """Adds ``OUTPUTS``, each after ``prefix``: the cleaned text, the counts behind the verdict, and ``kept``."""
    real = lambda line: line.rlike(f"[^{SPACE}]")
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    body, long = F.coalesce(F.col(text), F.lit("")), lambda n: n.cast("long")
    made = unused(df, *[f"_{x}" for x in ("words", "lines", "real", "clean", *OUTPUTS)], also=[prefix + x for x in OUTPUTS])
    word_list, lines, filled, clean, *outputs = made
    out = dict(zip(OUTPUTS, outputs, strict=True))
    found = (
        df.withColumn(word_list, words(F.col(text)))
        .withColumn(lines, F.split(body, "\n"))
        .withColumn(filled, F.filter(lines, real))
        .withColumn(out["n_symbols"], long(F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", ""))))
        .withColumn(clean, F.when(may_fail(body, F.col(lines), F.col(out["n_symbols"]), rules), F.filter(lines, lambda x: ~real(x) | ~line_fails(x, rules))).otherwise(F.col(lines)))
        .withColumns(
            {
                out["clean_text"]: F.array_join(clean, "\n"),
                out["n_words"]: long(F.size(word_list)),
                out["word_chars"]: long(F.length(F.array_join(word_list, ""))),
                out["n_dup_lines"]: long(F.size(filled) - F.size(F.array_distinct(filled))),
                out["n_repeat_words"]: long(repeated_words(F.transform(word_list, lambda w: F.xxhash64(w)))),
                out["line_chars"]: size(F.col(lines)),
                out["kept_chars"]: size(F.col(clean)),
                out["n_lines"]: long(F.size(filled)),
                out["n_failed_lines"]: long(F.size(lines) - F.size(clean)),
            }
        )
    )
    x = {name: F.col(c) for name, c in out.items()}
    failed = (x["n_words"] < rules.min_words) | (100 * x["n_repeat_words"] > rules.max_repeat_percent * x["n_words"])
    lost = 100 * (x["line_chars"] - x["kept_chars"]) > rules.max_lost_percent * x["line_chars"]
    judged = found.withColumn(out["base_failed"], failed).withColumn(out["kept"], ~x["base_failed"] & ~lost)
    return judged.withColumns({prefix + name: x[name] for name in OUTPUTS}).drop(*made)
