"""Bracket index of JavaScript and TypeScript text.

One pass over a text gives every opening bracket its closing position; strings,
comments, regular expressions and the text of templates are left out.  All
later questions (the arguments of a call, the span of a loop) jump from bracket
to bracket, so many calls in one file cost its length once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

_TOKEN = re.compile(
    r"""[^'"`/()\[\]{}]+|//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?|.""", re.S
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))+|\$\{|`|\\\Z", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: What stands before a regular expression; after anything else a slash divides.
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*$")
_NOT_LINE = re.compile(r"[^\n]")
PAIRS = {")": "(", "]": "[", "}": "{"}
_SPLIT = re.compile(r"[,()\[\]{}]")
_FOR = re.compile(r"(?<![\w$.])for\s*\(")
_IN = re.compile(r"\s*(?:(?:const|let|var)\s+)?(?:[\w$.]+|[\[{].*[\]}])\s+in\b", re.S)
_OWN = re.compile(r"(?<![\w$])(?:hasOwnProperty(?:\s*\.\s*call)?|hasOwn)\s*(?=\()")
_TYPES = re.compile(r"<[\w\s,.|&\[\]]*>$")


def _blank(text: str) -> str:
    return _NOT_LINE.sub(" ", text)


@dataclass(frozen=True)
class Call:
    """``name`` is the chain of names that is called, ``last`` its last one, ``member`` whether it is a member of something."""

    start: int
    open: int
    name: str
    last: str
    member: bool
    made: bool


class Brackets:
    """``code`` is the text with everything blanked that is not code; ``close`` leads from opening to closing positions."""

    def __init__(self, text: str):
        self.text, self.close = text, {}
        self._begins: dict[int, int] = {}  # where chains of calls begin, by their brackets
        out: list[str] = []
        stack: list[tuple[str, int]] = []
        held = {"(": 0, "[": 0, "{": 0}
        at, size = 0, len(text)
        before = ""  # the end of the code so far, without blanked parts
        while at < size:
            if stack and stack[-1][0] == "`":
                m = _TEMPLATE.match(text, at)
                piece = m[0]
                if piece == "`":
                    stack.pop()
                    before = "`"
                    out.append("`")
                elif piece == "${":
                    stack.append(("{", at + 1))
                    held["{"] += 1
                    before = "{"
                    out.append(" {")
                else:
                    out.append(_blank(piece))
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            piece = m[0]
            first = piece[0]
            if first == "/" and len(piece) == 1:
                found = _REGEX.match(text, at) if _BEFORE_REGEX.search(before) else None
                if found:
                    m, piece = found, "/" + _blank(found[0][1:-1]) + "/"
                    before = "0"
                else:
                    before = "/"
            elif first in "'\"":
                closed = len(piece) > 1 and piece[-1] == first
                piece, before = (first + _blank(piece[1:-1]) + first if closed else _blank(piece)), first
            elif piece.startswith(("//", "/*")):
                piece = _blank(piece)
            elif first == "`":
                stack.append(("`", at))
            elif first in "([{":
                stack.append((first, at))
                held[first] += 1
                before = first
            elif first in ")]}":
                if held[PAIRS[first]]:
                    while stack[-1][0] != PAIRS[first]:  # what is left open inside never closes
                        kind, _ = stack.pop()
                        if kind != "`":
                            held[kind] -= 1
                    kind, opened = stack.pop()
                    held[kind] -= 1
                    self.close[opened] = at
                before = first
            else:
                before = (before + piece)[-16:] if not piece.strip() else piece[-16:]
            out.append(piece)
            at = m.end()
        self.code = "".join(out)

    @cached_property
    def open_of(self) -> dict[int, int]:
        return {b: a for a, b in self.close.items()}

    @cached_property
    def _line_starts(self) -> list[int]:
        return list(accumulate((len(x) + 1 for x in self.text.split("\n")), initial=0))

    def line(self, at: int) -> int:
        """0-based line of a position."""
        return bisect_right(self._line_starts, at) - 1

    def call(self, opened: int) -> Call | None:
        """The call whose arguments the bracket at ``opened`` begins; None where no name stands before it."""
        code, i = self.code, opened
        names: list[str] = []
        whole, member, passed = True, False, [opened]
        while True:
            while i and code[i - 1].isspace():
                i -= 1
            if not names and code[max(0, i - 2) : i] == "?.":
                i -= 2
                continue
            if not names and i and code[i - 1] == ">" and (m := _TYPES.search(code, max(0, i - 80), i)):
                i = m.start()
                continue
            j = i
            while j and (code[j - 1].isalnum() or code[j - 1] in "_$"):
                j -= 1
            if j == i:
                if not names:
                    return None
                # a member of a call or of an element: the chain goes on before its bracket
                if i and code[i - 1] in ")]" and i - 1 in self.open_of:
                    if whole and code[i - 1] == "]":
                        names.append("?")
                    whole, i = False, self.open_of[i - 1]
                    if i in self._begins:
                        start = self._begins[i]
                        break
                    passed.append(i)
                    k = i
                    while k and code[k - 1].isspace():
                        k -= 1
                    if k and (code[k - 1].isalnum() or code[k - 1] in "_$)]"):
                        i = k
                        continue
                start = i
                break
            word = code[j:i]
            if whole:
                names.append(word)
            start = i = j
            k = j
            while k and code[k - 1].isspace():
                k -= 1
            # a line that ends in a dot ends a sentence, not the first half of a chain
            if not k or code[k - 1] != "." or code[max(0, k - 3) : k] == "..." or "\n" in code[k:j]:
                break
            member = True
            k -= 1
            if k and code[k - 1] in "?!":
                k -= 1
            i = k
        self._begins.update(dict.fromkeys(passed, start))
        if len(names) > 1 and names[-1] in ("this", "super"):
            names.pop()
        head = code[max(0, start - 12) : start].rstrip()
        if re.search(r"(?:^|[^\w$.])function\s*\*?$", head):
            return None
        return Call(start, opened, ".".join(reversed(names)), names[0], member, bool(re.search(r"(?:^|[^\w$.])new$", head)))

    def parts(self, opened: int) -> list[tuple[int, int]]:
        """Bounds of what commas divide inside a bracket, without blanks around; brackets inside are skipped."""
        end = self.close.get(opened)
        if end is None:
            return []
        out, first, at = [], opened + 1, opened + 1
        while m := _SPLIT.search(self.code, at, end):
            at = m.end()
            if m[0] == ",":
                out.append((first, m.start()))
                first = at
            elif m.start() in self.close:
                at = self.close[m.start()] + 1
        out.append((first, end))
        out = [self._trim(a, b) for a, b in out]
        return out[:-1] if out[-1][0] >= out[-1][1] else out

    def _trim(self, a: int, b: int) -> tuple[int, int]:
        """Without blanks and comments around; a string is not blank, its quotes stand in the code."""
        while a < b and self.code[a].isspace():
            a += 1
        while a < b and self.code[b - 1].isspace():
            b -= 1
        return a, b

    def is_object(self, a: int, b: int) -> bool:
        return a < b and self.code[a] == "{" and self.close.get(a) == b - 1

    def members(self, opened: int) -> list[tuple[str, int, int]]:
        """(key, bounds of the value) of an object's properties; a short one is its own value, spread ones and methods are left out."""
        out = []
        for a, b in self.parts(opened):
            m = re.compile(r"([\w$]+|'[^']*'|\"[^\"]*\")\s*").match(self.text, a, b)
            if m and m.end() < b and self.code[m.end()] == ":":
                out.append((m[1], *self._trim(m.end() + 1, b)))
            elif m and m.end() >= b and self.code[a] not in "'\"":
                out.append((m[1], a, b))
        return out

    def values(self, a: int, b: int, most: int = 64) -> list[str]:
        """The expression, or of an object the values of its properties, through objects in objects."""
        todo, out = [(a, b, 0)], []
        while todo:
            a, b, depth = todo.pop()
            if self.is_object(a, b) and depth < most:
                todo += [(x, y, depth + 1) for _, x, y in self.members(a)]
            else:
                out.append(self.text[a:b])
        return out

    def loops(self) -> list[tuple[int, int]]:
        """(begin, end) of ``for … in`` loops whose body has no call that tests own members."""
        out, guards = [], None
        for m in _FOR.finditer(self.code):
            opened = m.end() - 1
            end = self.close.get(opened)
            if end is None or not _IN.match(self.code, opened + 1, end):
                continue
            if guards is None:
                guards = [g.start() for g in _OWN.finditer(self.code) if self._tests_own(g)]
            first, last = self.statement(end + 1)
            k = bisect_right(guards, first - 1)
            if k == len(guards) or guards[k] >= last:
                out.append((m.start(), last))
        return out

    def _tests_own(self, g: re.Match) -> bool:
        call = self.call(self.code.index("(", g.end()))
        return call is not None and (call.name.endswith(".hasOwnProperty") or call.name in ("Object.hasOwn", "Object.prototype.hasOwnProperty.call"))

    def statement(self, at: int) -> tuple[int, int]:
        """Bounds of the statement at ``at``: a block, or up to a semicolon, a line's end or the end of what is around it."""
        code, size = self.code, len(self.code)
        while at < size and code[at].isspace():
            at += 1
        if at < size and code[at] == "{":
            return at, self.close.get(at, size - 1) + 1
        end = at
        step = re.compile(r"[;\n()\[\]{}]")
        while m := step.search(code, end):
            if m[0] in "([{":
                if m.start() not in self.close:
                    break
                end = self.close[m.start()] + 1
            else:
                return at, m.start() + (m[0] == ";")
        return at, size
