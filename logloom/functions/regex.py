"""Linear-time regular expressions for Spark: a linter for the RE2 subset, and its translation to Java patterns with numbered groups."""

from __future__ import annotations

import re

#: Constructs that a linear-time engine doesn't have.
FORBIDDEN = {"(?=": "lookahead", "(?!": "lookahead", "(?<=": "lookbehind", "(?<!": "lookbehind", "(?>": "atomic group", "(?(": "conditional", "(?P=": "backreference", "(?#": "comment"}

_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_ESCAPES = {"s": "\\t\\n\\f\\r ", "d": "0-9", "w": "0-9A-Za-z_"}


class UnsafePattern(ValueError):
    pass


def _walk(pattern: str):
    """(place, text, in_class) of the pattern's units: an escape, or one character."""
    at, inside = 0, False
    while at < len(pattern):
        unit = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        yield at, unit, inside
        if unit == "[" and not inside:
            inside = True
            at += 1
            if pattern[at : at + 1] == "^":
                yield at, "^", True
                at += 1
            if pattern[at : at + 1] == "]":
                yield at, "]", False  # a literal one
                at += 1
            continue
        if unit == "]" and inside:
            inside = False
        at += len(unit)


def lint(pattern: str) -> list[str]:
    """Why a linear-time engine would reject the pattern; empty if it wouldn't."""
    problems = []
    if not isinstance(pattern, str):
        return ["not a string"]
    last = ""
    for at, unit, inside in _walk(pattern):
        if not inside:
            problems += [f"{what} at {at}" for start, what in FORBIDDEN.items() if pattern.startswith(start, at) and unit == "("]
            if unit[0] == "\\" and len(unit) == 2 and (unit[1] in "123456789kKXRG" or unit[1] == "Z"):
                problems.append(f"escape {unit} at {at}")
            if unit == "+" and last in ("+", "*", "?", "}") and not (last == "+" and pattern[at - 2 : at - 1] == "\\"):
                problems.append(f"possessive quantifier at {at}")
        last = unit
    if pattern.endswith("\\") and (len(pattern) - len(pattern.rstrip("\\"))) % 2:
        problems.append("trailing backslash")
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))
    except re.error as e:
        problems.append(str(e))
    return problems


def group_names(pattern: str) -> list[str]:
    return [m[1] for m in _NAMED.finditer(pattern)]


def optional_groups(pattern: str) -> bool:
    """Whether a named group can take no part in a match."""
    compiled = re._parser.parse(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))

    def look(items, may_skip: bool) -> bool:
        for op, value in items:
            name = str(op)
            if name == "SUBPATTERN":
                if (value[0] and may_skip) or look(value[-1], may_skip):
                    return True
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                if look(value[2], may_skip or value[0] == 0):
                    return True
            elif name == "BRANCH":
                if any(look(branch, True) for branch in value[1]):
                    return True
        return False

    return look(compiled, False)


def to_java(pattern: str) -> tuple[str, list[str], list[int]]:
    """A Java pattern of equal meaning, the names of its named groups and their numbers.

    Named groups become numbered ones, as Java's names have no underscore. Line ends are \\n only; $ is the end of the text; the
    classes \\s, \\d and \\w are those of ASCII without the vertical tab.
    """
    if problems := lint(pattern):
        raise UnsafePattern("; ".join(problems))
    out, names, numbers, groups = ["(?d)"], [], [], 0
    skip = 0
    for at, unit, inside in _walk(pattern):
        if at < skip:
            continue
        if not inside and unit == "(":
            if m := _NAMED.match(pattern, at):
                groups += 1
                names.append(m[1])
                numbers.append(groups)
                out.append("(")
                skip = m.end()
                continue
            if not pattern.startswith("(?", at):
                groups += 1
            out.append("(")
        elif not inside and unit == "$":
            out.append("\\z")
        elif unit[0] == "\\" and len(unit) == 2 and unit[1].lower() in _ESCAPES:
            body = _ESCAPES[unit[1].lower()]
            if inside:
                out.append(body if unit[1].islower() else f"[^{body}]")
            else:
                out.append(f"[{body}]" if unit[1].islower() else f"[^{body}]")
        elif inside and unit == "[":
            out.append("\\[")
        elif inside and unit == "&":
            out.append("\\&")
        elif unit == "]" and not inside:
            out.append("\\]")
        else:
            out.append(unit)
    return "".join(out), names, numbers
