"""Token counts attributed to the sections of a document by character offsets.

A document is encoded once, whole. The spans of its tokens are then joined to the
spans of its sections, in order, and each token counts for one section or for
several by shares, as ``rule`` says:

``first``: for the section of its first character; ``last``: of its last;
``share``: for every section it touches, by its bytes there.

A section is a line with the line break that ends it, so sections tile the text.

Defined results: a null or empty text has one empty section and no tokens; lines
may be empty; strings of special tokens are ordinary text; texts, lines and runs of
any length are encoded whole; repeated rows are counted each for itself; an empty
table gives an empty result. A token that ends where a section ends is no tie: it
belongs to what it holds. Only the id and the text are read, so further columns have
no part in the result, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "share")
#: What the pattern holds to be white space. A longer run than ``LONG`` is cut off before the pattern is applied.
LONG, BLANKS = 1_000, r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{BLANKS}]{{{LONG},}}")


class Tokenizer:
    """A byte-level vocabulary and how many bytes each of its tokens stands for."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.whole = tiktoken.Encoding("one piece", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(max(merges.values()) + 1, np.int64)
        for token, rank in merges.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte after the last of each token."""
        return np.cumsum(self.sizes[self.encode(text)])

    def encode(self, text: str) -> list[int]:
        """The tokens of the text.

        The pattern steps back through a run of white space, once for each of its characters, which a run of a million
        does not survive. It always cuts before a run, and before the last character of a run that is not the end of the
        text, as that one is left to the word behind it. So long runs are cut there beforehand and merged as one piece.
        """
        found, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            found += self.encoding.encode_ordinary(text[at : run.start()])
            found += self.whole.encode_ordinary(text[run.start() : end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:])


def section_counts(text: str, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each section: first character, character after the last, tokens, and tokens that cross its end."""
    data = np.frombuffer(text.encode(), np.uint8)
    stops = np.append(np.flatnonzero(data == 10) + 1, len(data))  # bytes after the sections
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(stops, starts, "right")
    last = np.searchsorted(stops, ends - 1, "right") if len(ends) else first
    n = len(stops)
    if rule == "share":
        counts = np.zeros(n)
        inside = first == last
        counts += np.bincount(first[inside], minlength=n)
        for i in np.flatnonzero(~inside):
            for s in range(first[i], last[i] + 1):
                low, high = max(starts[i], stops[s - 1] if s else 0), min(ends[i], stops[s])
                counts[s] += (high - low) / (ends[i] - starts[i])
    else:
        counts = np.bincount(first if rule == "first" else last, minlength=n).astype(float)
    crossing = np.bincount(first[first != last], minlength=n)
    limits = leads[stops]
    return np.concatenate([[0], limits[:-1]]), limits, counts, crossing


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """A row for each section: document, section from 0, start and end character, tokens, tokens crossing its end.

    The vocabulary, whose size is that of its file, is read once and broadcast;
    executors need no file of their own.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = ship(docs.sparkSession).sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(ranks.value)
        for pdf in batches:
            parts, size = [], 0
            for key, body in zip(pdf["id"], pdf["body"], strict=True):
                low, high, counts, crossing = section_counts(body, tokenizer.ends(body), rule)
                parts.append((key, low, high, counts, crossing))
                size += len(low)
                if size >= 50_000:
                    yield _frame(parts)
                    parts, size = [], 0
            if parts:
                yield _frame(parts)

    key_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {key_type}, section int, start_char long, end_char long, n_tokens double, n_crossing long"
    # pandas would turn keys into floats where some are null: they travel as strings
    body = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    counted = body.mapInPandas(count, schema.replace(f"id {key_type}", "id string"))
    exact = F.col("n_tokens") if rule == "share" else F.col("n_tokens").cast("long")
    return counted.select(F.col("id").cast(key_type).alias(doc_id), "section", "start_char", "end_char", exact.alias("n_tokens"), "n_crossing")


def _frame(parts: list) -> pd.DataFrame:
    sizes = [len(p[1]) for p in parts]
    return pd.DataFrame(
        {
            "id": np.repeat(np.array([p[0] for p in parts], object), sizes),
            "section": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
            "start_char": np.concatenate([p[1] for p in parts]),
            "end_char": np.concatenate([p[2] for p in parts]),
            "n_tokens": np.concatenate([p[3] for p in parts]),
            "n_crossing": np.concatenate([p[4] for p in parts]),
        }
    )
