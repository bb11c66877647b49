"""Tokens of JavaScript and TypeScript, by an automaton with a stack of modes, in Arrow batches.

What a sign means depends on what surrounds it: in code, in the text of a template, in a tag, or between tags. The
automaton holds these modes, with the open brackets, on one stack. It only tells tokens apart, pairs brackets and names
what is called; which of them form functions, imports or edges is read from the table of tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

#: Words after which an expression begins, and words before a bracket that make it no call.
BEFORE_EXPRESSIONS = frozenset("return typeof case in of delete void throw new do else instanceof await yield extends default".split())
NOT_CALLED = BEFORE_EXPRESSIONS | frozenset("if for while switch catch with function async constructor".split())
#: What goes on with the expression of the line before, so that no statement ends there.
GOES_ON = frozenset(". ?. ( [ { ` `{ + - * / % ** = == === != !== += -= *= /= && || ?? ? : => , ) ] } < > <= | & ^ ; in instanceof as satisfies of extends implements".split())
#: Modifiers of class members.
MODIFIERS = frozenset("public private protected static async override readonly abstract declare accessor get set".split())
NAME = r"[#]?(?:[^\W\d]|\$)[\w$]*"

_BLANK = re.compile(r"(?:\s++|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))++")
_STRING = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\""
_TOKEN = re.compile(
    rf"(?P<name>{NAME})|(?P<string>{_STRING})|(?P<number>\.?\d[\w.]*+)"
    r"|(?P<sign>=>|\.\.\.|\?\.(?!\d)|===?|!==?|<=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*|[-+*/%&|^]=|(?s:.))"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
_TEMPLATE_TEXT = re.compile(r"[^`\\$]*+(?:(?:\\(?s:.)|\$(?!\{))[^`\\$]*+)*+")
_ELEMENT = re.compile(rf"<(?=>|{NAME})(?!\s*{NAME}\s*(?:,|extends\b))")
_TAG_PART = re.compile(r"""\s++|//[^\n]*+|/\*(?s:.*?)\*/|[\w$:.\-]++|=|"[^"]*+"|'[^']*+'|<[^<>]*+>""")
_CLOSING_TAG = re.compile(r"</[^<>]*+>")
_KIDS_TEXT = re.compile(r"[^<{]++")
_PAIR = {")": "(", "]": "[", "}": "{"}
#: Openers that code braces close, by the mode that they open.
_BRACES = ("{", "${", "<{")

#: Modes that no bracket of code closes.
_WALLS = ("`{", "<jsx", "kids")

SCHEMA = "path string, file_ord int, ord int, t string, place int, size int, end_place int, line int, end_line int, col int, depth int, within int, pair int, angle int, fresh boolean, stop boolean, decorator boolean, callee string, head int, head_line int, head_col int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")])


class Lexer:
    """One file's tokens, without comments and white space, as columns.

    ``depth``, ``within``: brackets around a token, and the order of the innermost; ``pair``: of brackets and of the
    angles of type arguments, the order of the other one; ``angle``: how many type arguments hold the token within its
    bracket; ``head``: the first token of the chain of members and calls that it belongs to; ``fresh``: a line break stands
    before it; ``stop``: a statement begins here on a new line; ``callee``: of a bracket of arguments, the name called, or ``)`` for what has none.
    A template with code, the code in it, a tag and what stands between its ends are brackets too, so that depths tell
    them from what is outside: ```{``, ``${``, ``<jsx`` and ``<{``.
    """

    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx = text, jsx
        self.t: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.within: list[int | None] = []
        self.pair: list[int | None] = []
        self.head: list[int] = []
        self.ends: list[bool] = []  # an expression may end with this token
        self.fresh: list[bool] = []  # a line break stands before it
        self.callee: list[str | None] = []
        self.stack: list[int] = []  # openers
        self.mode: list[str] = []  # what each opener opened: its own sign, or kids between tags
        self.angles: list[list[int]] = [[]]  # of each bracket, angles that may hold type arguments
        self.counts: list[dict[str, int]] = [{}]  # of brackets by sign, since each template or tag
        self.built: set[int] = set()  # chains whose ``new`` has its bracket
        self.class_at: list[bool] = [False]  # of each bracket: a class has begun and waits for its body
        self.class_bodies: set[int | None] = set()
        self._run()

    def _emit(self, t: str, start: int, end: int, head: int | None = None, ends: bool = False) -> int:
        i = len(self.t)
        self.t.append(t)
        self.fresh.append(self.broke)
        self.start.append(start)
        self.end.append(end)
        self.depth.append(len(self.stack))
        self.within.append(self.stack[-1] if self.stack else None)
        self.pair.append(None)
        self.head.append(i if head is None else head)
        self.ends.append(ends)
        self.callee.append(None)
        self.broke = False
        return i

    def _open(self, t: str, start: int, end: int, head: int | None = None) -> int:
        i = self._emit(t, start, end, head)
        self.stack.append(i)
        self.mode.append(t)
        if t in _WALLS:
            self.counts.append({})
        else:
            self.counts[-1][t] = self.counts[-1].get(t, 0) + 1
        self.angles.append([])
        if t == "{" and self.class_at[-1]:
            self.class_bodies.add(i)
            self.class_at[-1] = False
        self.class_at.append(False)
        return i

    def _close(self, t: str, start: int, end: int, ends: bool) -> None:
        i, opener = self._emit(t, start, end), self.stack[-1]
        self._drop()
        self.pair[i], self.pair[opener], self.head[i], self.ends[i] = opener, i, self.head[opener], ends

    def _drop(self) -> None:
        if self.mode[-1] in _WALLS:
            self.counts.pop()
        else:
            self.counts[-1][self.mode[-1]] -= 1
        for of_frame in (self.stack, self.mode, self.angles, self.class_at):
            of_frame.pop()

    def _run(self) -> None:
        at, n, self.broke = 0, len(self.text), False
        while at < n:
            mode = self.mode[-1] if self.mode else ""
            at = self._template(at) if mode == "`{" else self._tag(at) if mode == "<jsx" else self._kids(at) if mode == "kids" else self._code(at)

    def _template(self, at: int) -> int:
        at = _TEMPLATE_TEXT.match(self.text, at).end()
        if self.text.startswith("${", at):
            self._open("${", at, at + 2)
            return at + 2
        if at < len(self.text):  # a back tick, or a backslash at the end of the file
            self._close("`}", at, at + 1, True)
        return at + 1

    def _tag(self, at: int) -> int:
        if m := _TAG_PART.match(self.text, at):
            return m.end()
        if self.text.startswith("/>", at):
            self._close("jsx>", at, at + 2, True)
            return at + 2
        if self.text[at] == "{":
            self._open("<{", at, at + 1)
        elif self.text[at] == ">":
            self.mode[-1] = "kids"
        return at + 1

    def _kids(self, at: int) -> int:
        if m := _KIDS_TEXT.match(self.text, at):
            return m.end()
        if m := _CLOSING_TAG.match(self.text, at):
            self._close("jsx>", at, m.end(), True)
            return m.end()
        self._open("<{" if self.text[at] == "{" else "<jsx", at, at + 1)
        return at + 1

    def _begins(self) -> bool:
        """Does an expression begin here, so that a slash or an angle is no operator?"""
        if not self.t:
            return True
        p = self.t[-1]
        if p == ")" and self.pair[-1]:
            return self.t[self.pair[-1] - 1] in ("if", "while", "for", "with")
        if p[0].isalpha() or p[0] in "_$#":
            return p in BEFORE_EXPRESSIONS and not self._member(len(self.t) - 1)
        return not self.ends[-1] and p not in ("++", "--")

    def _member(self, i: int) -> bool:
        return i > 0 and self.t[i - 1] in (".", "?.")

    def _code(self, at: int) -> int:
        text = self.text
        if m := _BLANK.match(text, at):
            self.broke |= "\n" in m[0]
            return m.end()
        c = text[at]
        if c == "`":
            whole = _TEMPLATE_TEXT.match(text, at + 1).end()
            head = self._head(at)
            if text.startswith("`", whole):
                self._emit("`", at, whole + 1, head, True)
                return whole + 1
            self._open("`{", at, at + 1, head=head)
            return at + 1
        if c in "/<" and self._begins():
            if c == "/" and (m := _REGEX.match(text, at)):
                self._emit("/", at, m.end(), None, True)
                return m.end()
            if c == "<" and self.jsx and _ELEMENT.match(text, at):
                self._open("<jsx", at, at + 1)
                return at + 1
        m = _TOKEN.match(text, at)
        t, i = m[0], len(self.t)
        if m.lastgroup == "sign":
            self._sign(t, at, m.end())
        else:
            member = i > 0 and (self.t[-1] in (".", "?.") or self.t[-1] in ("new", "@") and not self._member(i - 1))
            word = m.lastgroup == "name"
            self._emit(t, at, m.end(), self.head[-1] if member else None, not word or t not in NOT_CALLED or self._member(i))
            if t == "class" and not self._member(i):
                self.class_at[-1] = True
        return m.end()

    def _head(self, at: int) -> int | None:
        """The chain that a bracket or a template goes on with, if one ends before it."""
        return self.head[-1] if self.t and (self.ends[-1] or self.t[-1] == "?.") and self.t[-1] != "}" else None

    def _sign(self, t: str, at: int, end: int) -> None:
        i = len(self.t)
        if t in ("(", "["):
            k = self._called(i) if t == "(" else None
            head = self.head[k] if k is not None else self._head(at)
            if head is None and self.t and self.t[-1] == "new":
                head = self.head[-1]
            self._open(t, at, end, head=head)
            if k is not None:
                self.callee[i] = ")" if self.t[k] in ("super", "import") and not self._member(k) or not re.match(NAME, self.t[k]) else self.t[k]
                if self.t[head] == "new" and head not in self.built:
                    self.built.add(head)
                    self.callee[i] = None
        elif t == "{":
            self._open(t, at, end)
        elif t in _PAIR:
            wanted = _BRACES if t == "}" else (_PAIR[t],)
            if not any(self.counts[-1].get(w) for w in wanted):
                self._emit(t, at, end)
                return
            while self.mode[-1] not in wanted:  # brackets left open inside
                self._drop()
            self._close(t, at, end, t != "}" or self.mode[-1] != "{")
        elif t == "<":
            self._emit(t, at, end)
            self.angles[-1].append(i)
        elif t == ">":
            self._emit(t, at, end)
            if self.angles[-1]:
                opener = self.angles[-1].pop()
                self.pair[i], self.pair[opener] = opener, i
        else:
            chained = t in (".", "?.", "!") and self.t and self.ends[-1] and not (t == "!" and self.broke)
            self._emit(t, at, end, self.head[-1] if chained else None, chained and t == "!")
            if t in (";", "&&", "||", "==", "===", "+", "-", "*", "/", "%"):
                self.angles[-1].clear()

    def _called(self, i: int) -> int | None:
        """The token that ends what a bracket at ``i`` calls, or none if it calls nothing."""
        k = i - 1
        if k >= 0 and self.t[k] == "?.":
            k -= 1
        if k > 0 and self.t[k] == ">" and self.pair[k] is not None:
            k = self.pair[k] - 1
            if k < 0 or not re.match(NAME, self.t[k]):
                return None
        while k > 0 and self.t[k] == "!" and self.ends[k]:
            k -= 1
        if k < 0 or not self.ends[k] or self.t[k] == "}" and self.t[i - 1] != "?.":
            return None
        before = self.t[k - 1] if k else ""
        defined = before == "function" or before == "*" and k > 1 and self.t[k - 2] == "function"
        return None if defined and re.match(NAME, self.t[k]) else k

    def stops(self) -> list[bool]:
        """Where a statement begins on a new line, after an expression or block that it can't go on with."""
        after = lambda i: self.ends[i - 1] or self.t[i - 1] in ("}", "++", "--")
        return [i > 0 and self.fresh[i] and after(i) and self.t[i] not in GOES_ON for i in range(len(self.t))]

    def _definitions(self, stops: list[bool]) -> None:
        """Brackets of parameters call nothing: those of methods, and of signatures in types."""
        for i, name in enumerate(self.callee):
            if name is None or self.pair[i] is None:
                continue
            k = i - 1
            if self.t[k] == ">":
                k = self.pair[k] - 1
            if self.t[k] == "]":  # a computed name
                k = self.pair[k]
            before, after = self.t[k - 1] if k else "", self.t[self.pair[i] + 1] if self.pair[i] + 1 < len(self.t) else ""
            begins = not k or before in ("{", ";", "}", ",", "*") or before in MODIFIERS or stops[k]
            braced = after == "{" and not self.fresh[self.pair[i] + 1] and not self._member(k)
            if braced or begins and (after == ":" or self.within[i] in self.class_bodies and before != ","):
                self.callee[i] = None

    def columns(self) -> dict[str, list]:
        stops, n = self.stops(), len(self.t)
        self._definitions(stops)
        angle, open_now = [0] * n, dict.fromkeys(self.within, 0)
        for i, w in enumerate(self.within):  # both signs count as inside
            typed = self.t[i] in ("<", ">") and self.pair[i] is not None
            open_now[w] += typed and self.t[i] == "<"
            angle[i] = open_now[w]
            open_now[w] -= typed and self.t[i] == ">"
        breaks = [m.start() for m in re.finditer("\n", self.text)]
        lines = [bisect_left(breaks, s) for s in self.start]
        last = [self.pair[i] if self.pair[i] is not None and self.pair[i] > i and self.t[i] != "<" else i for i in range(n)]
        end = [self.end[k] for k in last]
        cols = [s - (breaks[x - 1] if x else -1) for s, x in zip(self.start, lines, strict=True)]
        heads = [h + (self.t[h] == "@" and h + 1 < n) for h in self.head]
        return {
            "ord": list(range(n)), "t": self.t, "place": self.start, "size": [b - a for a, b in zip(self.start, self.end, strict=True)], "end_place": end,
            "line": [x + 1 for x in lines], "end_line": [bisect_left(breaks, e - 1) + 1 for e in end], "col": cols,
            "depth": self.depth, "within": self.within, "pair": self.pair, "angle": angle, "fresh": self.fresh, "stop": stops,
            "decorator": [self.t[h] == "@" for h in self.head], "callee": self.callee, "head": self.head, "head_line": [lines[h] + 1 for h in heads], "head_col": [cols[h] for h in heads],
        }


def has_tags(path: str | None) -> bool:
    """Not in TypeScript without ``x``, where an angle before an expression is a cast."""
    return not (path or "").lower().endswith((".ts", ".mts", ".cts"))


def lex(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Files (path, file_ord, content) as tokens."""
    held: dict[str, list] = {c: [] for c in _COLUMNS}
    for batch in batches:
        for path, file_ord, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Lexer(content or "", has_tags(path)).columns()
            n = len(found["ord"])
            for c, values in (found | {"path": [path] * n, "file_ord": [file_ord] * n}).items():
                held[c] += values
            if len(held["ord"]) >= rows:
                yield pa.record_batch([pa.array(held[f.name], f.type) for f in _ARROW], schema=_ARROW)
                held = {c: [] for c in _COLUMNS}
    yield pa.record_batch([pa.array(held[f.name], f.type) for f in _ARROW], schema=_ARROW)
