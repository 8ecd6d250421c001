"""Facts about calls and loops for the confirm stage, by line.

The brackets of a text need a running state over its characters, which
expressions over columns do not have; so files that hold one of the constructs
go through an Arrow function once, and all other files pass as nulls.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..catalog.detectors import ERROR_EXPOSURE, FUNCTION_CONSTRUCTOR, REDIRECT
from ..functions.brackets import Brackets
from ..functions.text import rx

#: Constructs whose structure the confirm stage looks at; files without any are not parsed.
TRIGGER = (r"\.\s*cookie\s*\(", r"\bfor\s*\([^;)]*\bin\b", r"Object\.assign\s*\(|merge\s*\(", FUNCTION_CONSTRUCTOR, REDIRECT)
ANSWER = r"\.(?:send|json)\s*\("
#: Last names of the calls that are kept.
CALLS = frozenset(("cookie", "assign", "replace", "redirect", "Function", "send", "json", "merge", "defaultsDeep", "deepmerge"))
_CALLED = re.compile(r"(?<![\w$])(?:" + "|".join(sorted(CALLS)) + r")\s*(?:<[\w\s,.|&\[\]]*>\s*)?(?:\?\.\s*)?(?=\()")

CALL = pa.struct([("name", pa.string()), ("member", pa.bool_()), ("made", pa.bool_()), ("args", pa.list_(pa.string())), ("options", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])
FACTS = pa.list_(pa.struct([("calls", pa.list_(CALL)), ("loop", pa.bool_())]))
CALLS_TYPE = "array<struct<name:string,member:boolean,made:boolean,args:array<string>,options:array<string>,values:array<string>>>"
FACTS_TYPE = f"array<struct<calls:{CALLS_TYPE},loop:boolean>>"


def call_facts(index: Brackets, opened: int) -> tuple[int, dict] | None:
    """Line on which a call begins, its name, arguments as written, the properties (``key:value``) of a third argument that is an object, and all values."""
    call = index.call(opened)
    if call is None or opened not in index.close:
        return None
    bounds = index.parts(opened)
    options = []
    if len(bounds) > 2 and index.is_object(*bounds[2]):
        options = [f"{key}:{index.text[a:b]}" for key, a, b in index.members(bounds[2][0])]
    values = [v for a, b in bounds for v in index.values(a, b)] if call.last in ("send", "json") else []
    return index.line(call.start), {
        "name": call.name, "member": call.member, "made": call.made, "args": [index.text[a:b] for a, b in bounds], "options": options, "values": values,
    }


def file_facts(text: str) -> list[dict | None]:
    """For each line the calls that begin on it and whether it lies in a ``for … in`` without a test of own members."""
    index = Brackets(text)
    out: list[dict | None] = [None] * (text.count("\n") + 1)
    for m in _CALLED.finditer(index.code):
        if found := call_facts(index, index.code.index("(", m.end())):
            line, call = found
            out[line] = out[line] or {"calls": [], "loop": False}
            out[line]["calls"].append(call)
    covered = -1  # loops come in order of their begin: a line inside several is marked once
    for begin, end in index.loops():
        first, last = index.line(begin), index.line(max(begin, end - 1))
        for line in range(max(first, covered + 1), last + 1):
            out[line] = (out[line] or {"calls": []}) | {"loop": True}
        covered = max(covered, last)
    return out


def _facts(contents: pa.Array) -> pa.Array:
    return pa.array([None if x is None else file_facts(x) for x in contents.to_pylist()], FACTS)


def line_facts(is_js: Column, content: Column) -> Column:
    """Facts aligned with the lines; null for files without any of the constructs."""
    wanted = rx(content, "|".join(f"(?:{x})" for x in TRIGGER)) | (content.rlike(ANSWER) & rx(content, ERROR_EXPOSURE))
    # Not deterministic as far as the optimizer goes: it must stay a column of its own and run once.
    return F.arrow_udf(_facts, FACTS_TYPE).asNondeterministic()(F.when(is_js & wanted, content))


# ------------------------------------------------------- tests on a line's facts
def any_call(test) -> Column:
    return F.exists(F.coalesce(F.col("facts.calls"), F.array().cast(CALLS_TYPE)), test)


def called(call: Column, *names: str) -> Column:
    """Whether the last name is one of those."""
    return F.substring_index(call["name"], ".", -1).isin(*names)


def last_argument(call: Column) -> Column:
    """Null for a call without arguments."""
    return F.get(call["args"], F.size(call["args"]) - 1)


def in_open_loop() -> Column:
    return F.coalesce(F.col("facts.loop"), F.lit(False))
