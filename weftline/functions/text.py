"""Regular expressions and whitespace with ECMAScript meaning on Spark.

The lineage rules are stated in ECMAScript syntax. Java differs in what ``\\s``,
``\\b`` and ``.`` cover, so patterns pass through :func:`java_regex` first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters ECMAScript counts as white space.
JS_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_regex(pattern: str) -> str:
    """Rewrite ``\\s``, ``\\b``, ``.`` and ``[^]`` so Java matches what ECMAScript would."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        if pattern.startswith("[^]", i) and not in_class:
            out.append(r"[\s\S]")
            i += 3
            continue
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(JS_SPACE if in_class else f"[{JS_SPACE}]")
            elif pair == r"\b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "." and not in_class:
            ch = r"[^\n\r\u2028\u2029]"
        out.append(ch)
        i += 1
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives; a pattern that is one group, or a boundary and one group, is opened."""
    opened = re.fullmatch(r"(?:\\b)?\((?:\?:)?(.*)\)(?:\\b)?", pattern, re.S)
    if opened and _closes_last(pattern):
        pattern = opened.group(1)
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _closes_last(pattern: str) -> bool:
    """Whether the first group of the pattern closes at its end."""
    depth, in_class, i = 0, False, 0
    body = pattern.removesuffix(r"\b")
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i == len(body) - 1
        i += 1
    return False


def _longest_literal(alternative: str) -> str:
    """Longest run of characters every match of the alternative contains."""
    runs, run, i = [], "", 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            i += 1
            ch = alternative[i]
            if ch.isalnum():
                runs.append(run)
                run = ""
            else:
                run += ch
        elif ch in "?*{":
            runs.append(run[:-1])
            run = ""
            if ch == "{":
                i = alternative.index("}", i)
        elif ch in "([":
            runs.append(run)
            run = ""
            depth, closing = 1, {"(": ")", "[": "]"}[ch]
            while depth:
                i += 1
                if alternative[i] == "\\":
                    i += 1
                elif alternative[i] == closing:
                    depth -= 1
                elif alternative[i] == ch and ch == "(":
                    depth += 1
        elif ch in ".+^$":
            runs.append(run)
            run = ""
        else:
            run += ch
        i += 1
    return max([*runs, run], key=len)


def needed_literals(pattern: str) -> list[str]:
    """Texts of which every match contains at least one; empty where none is known."""
    found = {_longest_literal(a) for a in _alternatives(pattern)}
    if any(len(f) < 2 for f in found):
        return []
    return sorted(f for f in found if not any(g != f and g in f for g in found))


def _may_match(text: Column, pattern: str, ignore_case: bool) -> Column | None:
    """A plain substring search for what any match must contain.

    Most texts fail it and never reach the regular expression.
    """
    literals = needed_literals(pattern)
    if not literals:
        return None
    if ignore_case:
        return one_of_substrings(F.lower(text), sorted({x.lower() for x in literals}))
    return one_of_substrings(text, literals)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs."""
    hit = text.rlike(("(?i)" if ignore_case else "") + java_regex(pattern))
    likely = _may_match(text, pattern, ignore_case)
    return hit if likely is None else likely & hit


def extract(text: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """First match's group, null where the pattern (or the group) does not take part."""
    flag = "(?i)" if ignore_case else ""
    return F.nullif(F.regexp_extract(text, flag + java_regex(pattern), group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """Every match's group in text order, '' where the group does not take part."""
    flag = "(?i)" if ignore_case else ""
    found = F.regexp_extract_all(text, F.lit(flag + java_regex(pattern)), F.lit(group))
    likely = _may_match(text, pattern, ignore_case)
    return found if likely is None else F.when(likely, found).otherwise(F.array().cast("array<string>"))


def extract_groups(text: Column, pattern: str, groups: dict[str, int], ignore_case: bool = False) -> Column:
    """Every match as a struct of named groups.

    The text is scanned once for whole matches and each short match is taken
    apart on its own; a pattern that looks ahead may only look for what ends a match.
    """
    whole = ("(?i)" if ignore_case else "") + java_regex(pattern)
    return F.transform(
        extract_all(text, pattern, 0, ignore_case),
        lambda match: F.struct(*[F.regexp_extract(match, whole, g).alias(name) for name, g in groups.items()]),
    )


def across_lines(pattern: str) -> str | None:
    """A pattern that occurs wherever ``pattern`` matches over the end of a line; null if it never does.

    Only white space may hold a line's end here; a pattern with anything else that may gives ``\\n``, which
    occurs in every text of several lines.
    """
    if re.search(r"\\[DSWnr]|\[\^|\[[^]]*\\s|\^|\$", pattern):
        return r"\n"
    wide = []
    for alternative in _alternatives(pattern):
        for space in re.finditer(r"\\s([*+]?)", alternative):
            held = r"\s*\n\s*" if space.group(1) else r"\n"
            wide.append(alternative[: space.start()] + held + alternative[space.end() :])
    return "|".join(wide) or None


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def one_of_substrings(text: Column, parts: list[str]) -> Column:
    """True where the text contains any of the literal parts."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found
