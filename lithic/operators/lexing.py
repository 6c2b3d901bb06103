"""Tokens of source files: one automaton with a stack of states, from left to right.

States are code, template literals, and the tags and text of markup in scripts;
code inside ``${}`` and ``{}`` of these is code again. Comments and blanks make no
token. Brackets are matched as they are met, and so are angle brackets that hold
type arguments. Every step consumes text or ends a state, and the patterns do not
go back, so a file takes time in proportion to its length.
"""

from __future__ import annotations

import re

# ---- fixed values of the languages
#: words after which an expression begins
BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "extends", "default"}
#: tokens that no type argument holds
NOT_IN_TYPES = {";", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "+", "-", "*", "/", "%", "!", "++", "--", "+=", "-="}
#: tokens after which a brace opens an object
BEFORE_OBJECT = {"=", "(", ",", "[", "?", "&&", "||", "??", "...", "<", "|", "&"}
CLOSED_BY = {")": "(", "]": "[", "}": "{"}

_SKIP = r"(?P<skip>(?:\s++|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))++)"
_WORD = r"(?P<word>#?(?:[^\W\d]|\$)[\w$]*+)"
_NUMBER = r"(?P<number>\d[\w.]*+)"
_STRING = r"\"(?:[^\"\\\n]|\\(?s:.))*+\"?|'(?:[^'\\\n]|\\(?s:.))*+'?"
_OTHER = r"(?P<other>=>|->|::|\?\.(?!\d)|\.\.\.|\+\+|--|[-+]=|[=!]==?|[<>]=|&&|\|\||\?\?|(?s:.))"
CODE = {
    "java": re.compile(rf'{_SKIP}|{_WORD}|{_NUMBER}|(?P<string>"""(?s:(?:[^\\]|\\.)*?)(?:"""|\Z)|{_STRING})|{_OTHER}'),
    "script": re.compile(rf"{_SKIP}|{_WORD}|{_NUMBER}|(?P<string>{_STRING})|(?P<tick>`)|(?P<slash>/)|{_OTHER}"),
}
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\n\[])++/\w*+")
_TEMPLATE = re.compile(r"(?:[^\\`$]|\\(?s:.)|\$(?!\{))*+(?:`|\$\{|\Z)")
_TEXT = re.compile(r"[^<{]*+(?:</|[<{]|\Z)")
_TAG = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^\"'{}<>/]|/(?!>))*+(?:/>|[>{]|\Z|(?s:.))")
#: what begins with "<" and a letter without being markup: type parameters of an arrow function
_PARAMETERS = re.compile(r"<\s*[\w$]+\s*(?:,|extends\b|=[^>])|<\s*[A-Z]\w?\s*>\s*\(")
_MARKUP = re.compile(r"<\s*(?:[\w$]|>)")


class Tokens:
    """The tokens of a text, in parallel lists.

    ``kind`` is w(ord), n(umber), s(tring or other literal) or p(unctuation);
    ``partner`` is the place of the bracket that a bracket matches, or -1;
    ``holder`` that of the innermost bracket around a token, or -1;
    ``role`` says of an opening brace whether it opens an object or a block, until more is known.
    """

    def __init__(self, text: str, language: str | None) -> None:
        self.source, self.language = text, language
        self.text: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.partner: list[int] = []
        self.holder: list[int] = []
        self.role: dict[int, str] = {}
        self._open: list[int] = []
        self._count = {"(": 0, "[": 0, "{": 0}
        self._angles: list[tuple[int, int]] = []
        self._case: dict[int, bool] = {}  # braces in which a case waits for its colon
        self._case_colon = -1
        self._run(CODE["java" if language == "java" else "script"].match)

    def __len__(self) -> int:
        return len(self.text)

    def _add(self, kind: str, text: str, at: int) -> int:
        self.kind.append(kind)
        self.text.append(text)
        self.at.append(at)
        self.partner.append(-1)
        self.holder.append(self._open[-1] if self._open else -1)
        return len(self.text) - 1

    def _run(self, match) -> None:
        text, n, at = self.source, len(self.source), 0
        states: list[tuple[str, int]] = []  # name, and for code how many brackets were open before it
        while at < n:
            state = states[-1][0] if states else "code"
            if state != "code":
                at = self._beside(state, states, at)
                continue
            m = match(text, at)
            kind, found = m.lastgroup, m[0]
            if kind == "skip":
                pass
            elif kind == "word":
                k = self._add("w", found, at)
                if found in ("case", "default"):
                    self._case[self.holder[k]] = True
            elif kind == "other":
                if found == "<" and self.language != "java" and self.language != "typescript" and not self.value_before() and _MARKUP.match(text, at) and not _PARAMETERS.match(text, at):
                    self._add("s", "<>", at)
                    states.append(("tag", 0))
                    at += 1
                    continue
                self._punctuation(found, at)
                if found == "}" and states and len(self._open) <= states[-1][1]:
                    states.pop()
            elif kind == "tick":
                self._add("s", "`", at)
                states.append(("template", 0))
            elif kind == "slash":
                literal = None if self.value_before() else _REGEX.match(text, at)
                self._add("s" if literal else "p", literal[0] if literal else "/", at)
                if literal:
                    at = literal.end()
                    continue
            else:
                self._add(kind[0], found, at)
                if kind == "number":
                    self._drop_angles()
            at = m.end()

    def _beside(self, state: str, states: list, at: int) -> int:
        """One step inside a template, a tag or the text between tags; where it ends."""
        m = {"template": _TEMPLATE, "text": _TEXT}.get(state, _TAG).match(self.source, at)
        end = m[0][-1:]
        if end == "{":
            states.append(("code", len(self._open)))
            self._punctuation("{", m.end() - 1)
            self.role[len(self.text) - 1] = "block"
        elif state == "template":
            states.pop()
        elif state == "text":
            states.append(("closing" if m[0].endswith("</") else "tag", 0)) if end else states.pop()
        elif m[0].endswith("/>"):
            states.pop()
        elif end == ">":
            states.pop()
            if state == "tag":
                states.append(("text", 0))
            elif states:  # the text of the element that is closed
                states.pop()
        elif not end:
            states.pop()
        at = max(m.end(), at + (not m[0]))
        if not states or states[-1][0] == "code" and end != "{":
            self._add("s", "", at)  # the literal is a value
        return at

    def _punctuation(self, found: str, at: int) -> None:
        opener = CLOSED_BY.get(found)
        if opener is None:
            k = self._add("p", found, at)
            if found in "([{":
                if found == "{":
                    self.role[k] = "object" if self._object(k) else "block"
                self._open.append(k)
                self._count[found] += 1
            elif found == "<":
                self._angles.append((k, len(self._open)))
            elif found == ">":
                if self._angles and self._angles[-1][1] == len(self._open):
                    other = self._angles.pop()[0]
                    self.partner[k], self.partner[other] = other, k
            elif found == ":" and self._case.pop(self.holder[k], False):
                self._case_colon = k
            elif found in NOT_IN_TYPES:
                self._drop_angles()
            return
        other = -1
        if self._count[opener]:  # brackets inside that were left open are given up
            while other < 0:
                top = self._open.pop()
                self._count[self.text[top]] -= 1
                if self.text[top] == opener:
                    other = top
        while self._angles and self._angles[-1][1] > len(self._open):
            self._angles.pop()
        k = self._add("p", found, at)
        if other >= 0:
            self.partner[k], self.partner[other] = other, k

    def _drop_angles(self) -> None:
        while self._angles and self._angles[-1][1] == len(self._open):
            self._angles.pop()

    def _object(self, k: int) -> bool:
        """Does the brace at k open an object (or its type) rather than a block?"""
        before = self.text[k - 1] if k else ""
        if before == ":" and k - 1 != self._case_colon:
            return True
        return before in BEFORE_OBJECT and self.kind[k - 1] == "p" or before in BEFORE_EXPRESSION - {"else", "do", "extends"} and self.kind[k - 1] == "w"

    def value_before(self) -> bool:
        """Does the last token end a value, so that no literal can begin here?"""
        if not self.text:
            return False
        last, kind, k = self.text[-1], self.kind[-1], len(self.text) - 1
        if kind == "w":
            return last not in BEFORE_EXPRESSION
        if kind in "ns" or last in ("]", "++", "--"):
            return True
        if last == ")":
            return not (self.partner[k] > 0 and self.text[self.partner[k] - 1] in ("if", "while", "for", "with"))
        return last == "}" and self.role.get(self.partner[k]) == "object"
