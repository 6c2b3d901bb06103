"""Declarations and facts of source files, taken from their tokens in one pass each.

No grammar is rebuilt: small recognisers look at a token and its neighbours, the
bracket it matches and the role of the brace around it. What counts are the
declarations and facts that the survey's capture lists name: classes, interfaces,
functions, methods and modules, imports, calls, heritage and exports. So
constructors, enums and records of Java, arrow and generator functions are no
symbols, ``new``, annotations and enum constants no calls, and only declared
classes, functions and interfaces are exported. Files are rows; Spark deals them
to tasks and Arrow carries the batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators.lexing import BEFORE_EXPRESSION, Tokens

# ---- fixed values: words that stand before a bracket without being called
NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "super", "import", "this", "new", "typeof", "await", "throw", "else", "do", "case", "in", "instanceof", "void", "delete", "yield", "synchronized", "try", "assert", "with", "class", "export"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "default", "strictfp", "transient", "volatile", "async", "readonly", "get", "set", "override", "declare", "accessor"}
#: words of types that another word follows
_TYPE_WORDS = {"is", "asserts", "keyof", "typeof", "infer", "unique", "readonly", "extends", "new", "abstract"}
_TYPE_BODIES = ("class", "interface", "enum", "record")


class _Scan:
    """Declarations and facts of one file, gathered from left to right."""

    def __init__(self, text: str, language: str | None) -> None:
        self.java, self.source = language == "java", text
        self.generics = language in ("java", "typescript", "tsx", None)
        self.tokens = t = Tokens(text, language)
        self.text, self.kind, self.at, self.partner, self.holder, self.role = t.text, t.kind, t.at, t.partner, t.holder, t.role
        self.symbols: list[tuple] = []
        self.facts: list[tuple] = []
        self._named: set[int] = set()  # tokens that name what is declared, or an annotation, or what is made by new
        self._constants: dict[int, int] = {}  # enum bodies, and where their constants end

    def run(self) -> None:
        heads = {"class": self._type, "interface": self._type, "import": self._import, "export": self._export, "new": self._new}
        heads |= {"enum": self._type, "record": self._type} if self.java else {"function": self._function, "namespace": self._module, "module": self._module}
        for i, kind in enumerate(self.kind):
            if kind == "w" and i not in self._named:
                head = heads.get(self.text[i])
                if not (head and head(i)):
                    self._member_or_call(i)
            elif kind == "p" and self.text[i] == "@":
                self._annotation(i)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] in "wp" and self.text[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "w"

    def _after(self, i: int) -> int:
        """The token behind i, or behind the bracket that i opens."""
        return (self.partner[i] if self.partner[i] > i else i) + 1

    def _arguments(self, i: int) -> int:
        """The bracket that opens the parameters or arguments of the name at i; -1 without one."""
        i += 1
        if self.is_(i, "<") and self.generics and self.partner[i] > i:
            i = self.partner[i] + 1
        return i if self.is_(i, "(") else -1

    def _declare(self, kind: str, i: int, body: int) -> None:
        end = self.at[self.partner[body]] if body >= 0 and self.partner[body] > body else -1
        if end < 0:
            end = self.source.find("\n", self.at[i])
        self.symbols.append((kind, self.text[i], self.at[i], end if end >= 0 else len(self.source)))
        self._named.add(i)

    def _statement(self, i: int) -> bool:
        """May a declaration begin at i, behind its modifiers?"""
        for _ in range(8):  # more modifiers than a declaration can have
            i -= self.word(i - 1) and self.text[i - 1] in MODIFIERS | {"export"}
        before = i - 1
        if before < 0 or self.is_(before, ";", "{", "}", ")", ">", "]") or self.kind[before] in "sn" or self.is_(before, "else", "do"):
            return True
        if self.is_(before, ":"):
            return self.role.get(self.holder[before]) != "object"
        return self.kind[before] == "w" and (self.text[before] not in BEFORE_EXPRESSION or self.text[before] == "default") and (self.is_(before - 1, "@") or "\n" in self.source[self.at[before] : self.at[i]])

    # ---- types

    def _type(self, i: int) -> bool:
        """A class, interface, enum or record, with its heritage; expressions and abstract classes of scripts are no declarations."""
        word, name = self.text[i], i + 1
        if self.is_(i - 1, ".", "?.", "::") or self.is_(i + 1, "(", ":", "=", ",", ")", ";", ".", "}", "[") and word != "class":
            return False
        anonymous = not self.word(name) or self.text[name] in ("extends", "implements") and not self.is_(name + 1, "{", "<", "extends", "implements")
        if anonymous and (word != "class" or self.java):
            return False
        if word == "record" and not self.is_(name + 1, "(", "<"):
            return False
        clauses: dict[str, list[int]] = {}
        j, clause = (i if anonymous else name) + 1, None
        while j < len(self.text) and not self.is_(j, "{", ";", "}", ")", "=", "=>", "class", "interface", "function"):
            if self.is_(j, "extends", "implements", "permits"):
                clause = clauses.setdefault(self.text[j], [])
            elif clause is not None and self.word(j) and self.is_(j - 1, "extends", "implements", ","):
                clause.append(j)
            j = self._after(j)
        body = j if self.is_(j, "{") else -1
        if body >= 0:
            self.role[body] = word
        elif not self.java and word == "interface":
            return False
        declared = not anonymous and word in ("class", "interface") and (self.java or self._statement(i) and not self.is_(i - 1, "abstract"))
        if declared:
            self._declare(word, name, body)
            for what, heirs in clauses.items():
                for k in heirs:
                    if what != "permits" and self._plain(k, what, word):
                        self.facts.append((what.upper(), self.text[k], self.at[k], self.at[name]))
        elif not anonymous:
            self._named.add(name)
        return True

    def _plain(self, k: int, what: str, word: str) -> bool:
        """Is the heir at k a simple name? Only what a script's class extends may have type arguments."""
        if self.is_(k + 1, ".", "(", "["):
            return False
        return not self.is_(k + 1, "<") or not self.java and word == "class" and what == "extends"

    # ---- functions, modules, members, calls

    def _function(self, i: int) -> bool:
        if self.is_(i + 1, "*"):
            if self.word(i + 2):
                self._named.add(i + 2)
            return True
        arguments = self._arguments(i + 1) if self.word(i + 1) else -1
        if arguments < 0:
            return True
        self._named.add(i + 1)
        body = self._body(arguments)
        if body >= 0 and self._statement(i):
            self._declare("function", i + 1, body)
        return True

    def _module(self, i: int) -> bool:
        if not (self.word(i + 1) and self.is_(i + 2, "{") and self._statement(i)):
            return False
        self.role[i + 2] = "block"
        self._declare("module", i + 1, i + 2)
        return True

    def _body(self, arguments: int) -> int:
        """The brace that opens the body of a function with these parameters: -1 without one, -2 if they are no parameters."""
        close = self.partner[arguments]
        if close < 0:
            return -2
        i = close + 1
        if self.java:
            while self.is_(i, "[", "]"):
                i += 1
            if self.is_(i, "throws"):
                while self.word(i) or self.is_(i, ".", ",", "@", "<"):
                    i = self._after(i)
            return i if self.is_(i, "{") else -1 if self.is_(i, ";") else -2
        if self.is_(i, ":"):
            i = self._type_end(i + 1)
        if self.is_(i, "{"):
            self.role[i] = "block"
            return i
        ended = i >= len(self.text) or self.is_(i, ";", "}", ",") or "\n" in self.source[self.at[i - 1] : self.at[i]]
        return -1 if ended else -2

    def _type_end(self, i: int) -> int:
        """The first token behind the type that begins at i."""
        complete = False
        while i < len(self.text):
            text, kind = self.text[i], self.kind[i]
            if kind == "w":
                if complete and text not in _TYPE_WORDS:
                    return i
                complete = text not in _TYPE_WORDS
            elif kind in "sn":
                complete = True
            elif text in ("|", "&", ".", "=>", "?", ":"):
                if text == ":" and not complete:
                    return i
                complete = False
            elif text in "([{<" and text:
                if text == "{" and complete or self.partner[i] < i:
                    return i
                if text == "(" and complete and not self.is_(i - 1, "new"):
                    return i
                if text == "{":
                    self.role[i] = "object"
                i, complete = self.partner[i], True
            else:
                return i
            i += 1
        return i

    def _new(self, i: int) -> bool:
        """What is made is not called: the last name of ``new a.b.C<..>(..)``. A body behind it is a class of its own."""
        j = i + 1
        if not self.word(j):
            return not self.is_(i + 1, "(", ":", "=", "?")
        while self.is_(j + 1, ".") and self.word(j + 2):
            self._named.add(j)
            j += 2
        self._named.add(j)
        arguments = self._arguments(j)
        if self.java and arguments >= 0 and self.partner[arguments] > 0 and self.is_(self.partner[arguments] + 1, "{"):
            self.role[self.partner[arguments] + 1] = "class"
        return True

    def _annotation(self, i: int) -> None:
        """Java's annotations are no calls; the decorators of scripts are."""
        if self.java and self.word(i + 1):
            if self.text[i + 1] == "interface":
                self._named.add(i + 1)
                if self.is_(i + 3, "{"):
                    self.role[i + 3] = "annotation"
                self._named.add(i + 2)
                return
            j = i + 1
            while self.is_(j + 1, ".") and self.word(j + 2):
                self._named.add(j)
                j += 2
            self._named.add(j)

    def _member_or_call(self, i: int) -> None:
        name = self.text[i]
        arguments = self._arguments(i)
        role = self.role.get(self.holder[i])
        if arguments < 0 and role in ("class", "interface", "object") and self.is_(i + 1, "?") and self.is_(i + 2, "("):
            arguments = i + 2  # an optional method
        if arguments < 0:
            if not self.java and self.is_(i + 1, "?.") and self.is_(i + 2, "(") and name not in NO_CALL and name[0] != "#":
                self.facts.append(("CALLS", name, self.at[i], -1))
            return
        if role in (_TYPE_BODIES if self.java else ("class", "interface", "object")) or role == "annotation":
            if (self._java_member if self.java else self._script_member)(i, arguments, role):
                return
        after_dot = self.is_(i - 1, ".", "?.")
        if name[0] == "#" or name in NO_CALL and not after_dot or self.java and self.is_(i - 1, "record"):
            return
        if name == "async" and self.partner[arguments] > 0 and self.is_(self.partner[arguments] + 1, "=>", ":"):
            return
        self.facts.append(("CALLS", name, self.at[i], -1))

    def _java_member(self, i: int, arguments: int, role: str) -> bool:
        """A method with a type before its name, a constructor or an enum constant; else it belongs to an initial value."""
        before = i - 1
        if role == "enum" and self._is_constant(i):
            body = self.partner[arguments] + 1
            if self.partner[arguments] > 0 and self.is_(body, "{"):
                self.role[body] = "class"
            return True
        typed = self.word(before) and self.text[before] not in MODIFIERS | NO_CALL - {"void"} or self.is_(before, "]")
        if self.is_(before, ">") and self.partner[before] >= 0:
            lead = self.partner[before] - 1
            typed = self.word(lead) and self.text[lead] not in MODIFIERS and lead not in self._named
        if self.word(before) and before in self._named:  # an annotation stands before a constructor
            typed = False
        if typed:
            body = self._body(arguments)
            if body == -2:
                return role == "annotation"
            if role != "annotation":
                self._declare("method", i, body)
            return True
        return before < 0 or self.is_(before, ";", "{", "}", ">", ")") or self.word(before) and (self.text[before] in MODIFIERS or before in self._named)

    def _is_constant(self, i: int) -> bool:
        """Is i among the constants of its enum, before the first semicolon of the body?"""
        body = self.holder[i]
        if body not in self._constants:
            j, end = body + 1, self.partner[body] if self.partner[body] > 0 else len(self.text)
            while j < end and not self.is_(j, ";"):
                j = self._after(j)
            self._constants[body] = j
        return i < self._constants[body]

    def _script_member(self, i: int, arguments: int, role: str) -> bool:
        """A method of a class or object, or the signature of one; else it belongs to an initial value."""
        name, start = self.text[i], i
        abstract = False
        while self.is_(start - 1, "*") or self.word(start - 1) and self.text[start - 1] in MODIFIERS and start - 1 > self.holder[i]:
            start -= 1
            abstract |= self.text[start] == "abstract"
        before = start - 1
        first = before == self.holder[i] or self.is_(before, ",", ";", "}")
        if not first and role != "object":
            decorated = self.is_(before, ")") and self.partner[before] > 1 and self.is_(self.partner[before] - 2, "@")
            value = self.kind[before] in "wns" and not self.is_(before, *BEFORE_EXPRESSION) or self.is_(before, ")", "]", ">")
            first = decorated or self.is_(before - 1, "@") or value and "\n" in self.source[self.at[before] : self.at[start]]
        if not first:
            return False
        body = self._body(arguments)
        if body == -2 or body == -1 and role == "object" and not self._signature(i, arguments):
            return False
        if name == "new" and role == "interface" or name[0] == "#" or abstract and body < 0:
            self._named.add(i)
        else:
            self._declare("method", i, body)
        return True

    def _signature(self, i: int, arguments: int) -> bool:
        """Does a name with brackets in a braced list end like a signature, with a type behind it?"""
        return self.is_(self.partner[arguments] + 1, ":", ";")

    # ---- imports and exports

    def _import(self, i: int) -> bool:
        """An import statement with its source; calls of import and require are none."""
        if self.is_(i - 1, ".", "?.") or self.is_(i + 1, "(", ".", ":", "=", ","):
            return self.is_(i + 1, ".")
        if self.java:
            j = i + 2 if self.is_(i + 1, "static") else i + 1
            parts = []
            while self.word(j) and not self.word(j - 1) or self.is_(j, ".") or j in (i + 1, i + 2) and self.word(j) and not parts:
                parts.append(self.text[j])
                j += 1
            name = "".join(parts).rstrip(".")
            if name and (self.is_(j, ";") or self.is_(j, "*")):
                self.facts.append(("IMPORTS", name, self.at[i], -1))
                self._named.update(range(i, j))
            return True
        j = i + 1
        while self.word(j) and self.text[j] not in ("import", "export", "class", "function") or self.is_(j, "*", ",", "{"):
            j = self._after(j)
        if self.is_(j, "=") and self.is_(j + 1, "require"):
            self._named.add(j + 1)
        if j < len(self.text) and self.kind[j] == "s" and self.text[j][:1] in ("'", '"') and (j == i + 1 or self.is_(j - 1, "from")):
            self.facts.append(("IMPORTS", self.text[j].strip(self.text[j][0]), self.at[i], -1))
            self._named.update(range(i, j))
        return True

    def _export(self, i: int) -> bool:
        """The name of an exported class, function or interface."""
        if self.java or self.is_(i - 1, ".", "?.") or not self._statement(i):
            return False
        j = i + 1
        while self.is_(j, "default", "async", "declare"):
            j += 1
        name = j + 1
        if self.is_(j, "class", "interface") and self.word(name) and not self.is_(name, "extends", "implements") or self.is_(j, "function") and self.word(name) and self._has_body(name):
            self.facts.append(("EXPORTS", self.text[name], self.at[name], -1))
        return True

    def _has_body(self, name: int) -> bool:
        arguments = self._arguments(name)
        return arguments >= 0 and self._body(arguments) >= 0


def scan(text: str, language: str | None) -> tuple[list[tuple], list[tuple]]:
    """Declarations (kind, name, at, end) and facts (type, name, at, owner) of a file by offset.

    A declaration ends at the brace that closes its body, or with its own line.
    The owner of a heritage fact is the offset of the declaration that has it.
    """
    found = _Scan(text, language)
    found.run()
    return sorted(found.symbols, key=lambda d: d[2]), sorted(found.facts, key=lambda f: f[2])


_ROWS = pa.schema([("what", pa.string()), ("type", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("end_at", pa.int64()), ("line", pa.int64()), ("column", pa.int64()), ("end_line", pa.int64()), ("owner_at", pa.int64()), ("around_line", pa.int64()), ("around_column", pa.int64()), ("qualified_name", pa.string())])
_DDL = "what string, type string, name string, at long, end_at long, line long, column long, end_line long, owner_at long, around_line long, around_column long, qualified_name string"
#: rows that a task holds before it sends them
_HOLD = 20_000


def nesting(symbols: list[tuple], points: list[int]) -> tuple[list[tuple[int | None, str | None]], list[int | None]]:
    """(start of the parent, qualified name) of each of a file's symbols(kind, name, start, end), start of the innermost function or method around each point.

    What ``symbols.nest`` and ``graph.enclosing`` say for tables of spans, in one
    pass over a file that is in hand: spans by start, the wider first.
    """
    order = sorted(range(len(symbols)), key=lambda k: (symbols[k][2], -symbols[k][3]))
    parents: list[tuple[int | None, str | None]] = [(None, None)] * len(symbols)
    open_: list[tuple] = []
    for k in order:
        _, name, start, end = symbols[k]
        open_ = [o for o in open_ if max(o[2], o[3]) >= start]
        outer = [o for o in open_ if (o[2] < start and o[3] >= end) or (o[2] == start and o[3] > end)]
        if outer:
            parents[k] = outer[-1][2], ".".join([*(o[1] for o in outer), name])
        open_.append(symbols[k])
    bodies: list[int | None] = [None] * len(points)
    spans = [symbols[k] for k in order if symbols[k][0] in ("function", "method") and symbols[k][2] <= symbols[k][3]]
    around: list[tuple] = []
    n = 0
    for k in sorted(range(len(points)), key=points.__getitem__):
        while n < len(spans) and spans[n][2] <= points[k]:
            around.append(spans[n])
            n += 1
        while around and around[-1][3] < points[k]:
            around.pop()
        bodies[k] = around[-1][2] if around else None
    return parents, bodies


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        owners: list[int] = []

        def send(batch=batch, rows=rows, owners=owners) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)] if rows else [pa.array([], f.type) for f in _ROWS]
            sent = pa.record_batch([batch.column(0).take(pa.array(owners, pa.int64())), *columns], names=["file", *_ROWS.names])
            rows.clear()
            owners.clear()
            return sent

        for k, (text, language) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            text = text.as_py() or ""
            feeds = [m.start() for m in re.finditer("\n", text)]
            place = lambda at, feeds=feeds: (n := bisect_right(feeds, at - 1), at - (feeds[n - 1] + 1 if n else 0))
            symbols, facts = scan(text, language.as_py())
            parents, bodies = nesting(symbols, [at for _, _, at, _ in facts])
            around = lambda at, place=place: (None, None) if at is None else place(at)
            rows += [("symbol", kind, name, at, end, *place(at), place(end)[0], None, *around(parent), qualified) for (kind, name, at, end), (parent, qualified) in zip(symbols, parents, strict=True)]
            rows += [("fact", kind, name, at, at, *place(at), place(at)[0], owner if owner >= 0 else None, *around(body), None) for (kind, name, at, owner), body in zip(facts, bodies, strict=True)]
            owners += [k] * (len(symbols) + len(facts))
            if len(rows) >= _HOLD:
                yield send()
        yield send()


def scan_files(files: DataFrame, carry: list[str]) -> DataFrame:
    """Symbols and facts of files(language, text, ...) with the files' columns ``carry``.

    ``what`` is symbol or fact, ``type`` its kind, ``at`` and ``end_at`` offsets,
    ``line`` and ``column`` count from 0, ``around_line`` and ``around_column`` are
    those of a symbol's parent and of the function or method around a fact. Files
    without a language are scripts.
    A null text has neither symbols nor facts.
    """
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.struct(*carry).alias("file"), F.col("text").cast("string").alias("text"), language.alias("language"))
    kind = rows.schema["file"].dataType.simpleString()
    return rows.mapInArrow(_scan_batches, f"file {kind}, {_DDL}").select("file.*", *_ROWS.names)
