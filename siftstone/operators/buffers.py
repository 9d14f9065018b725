"""Sizes in C: constant arithmetic, capacities of buffers, and writes that do not fit."""

from __future__ import annotations

import re

from siftstone.operators.lexing import _closing, tokenize

FAMILY = ("c", "h", "cpp", "cc", "cxx", "hpp", "hxx", "hh", "m", "mm")
# Bytes of types, and which argument of a call is written to and which one says how much.
TYPES = {"char": 1, "uint8_t": 1, "int8_t": 1, "u8": 1, "bool": 1, "short": 2, "uint16_t": 2, "int16_t": 2, "u16": 2, "int": 4, "unsigned": 4, "float": 4, "uint32_t": 4, "int32_t": 4, "u32": 4, "wchar_t": 4, "long": 8, "double": 8, "uint64_t": 8, "int64_t": 8, "u64": 8, "size_t": 8}
COUNTED = {
    "memcpy": (0, 2), "memmove": (0, 2), "memset": (0, 2), "bcopy": (1, 2), "strncpy": (0, 2), "strncat": (0, 2), "snprintf": (0, 1), "vsnprintf": (0, 1), "fgets": (0, 1), "read": (1, 2), "recv": (1, 2), "recvfrom": (1, 2),
}
COPIED = {"strcpy": 1, "stpcpy": 1, "strcat": 1, "sprintf": 1}  #: to argument 0, up to the end of this one
HEAP = {"malloc": (0,), "calloc": (0, 1), "realloc": (1,), "alloca": (0,), "kmalloc": (0,), "kzalloc": (0,)}


class Sizes:
    """Values of constant expressions: numbers, names, `sizeof`, and the operators of integers."""

    LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))

    def __init__(self, names: dict[str, int], capacities: dict[str, int]):
        self.names, self.capacities = names, capacities

    def of(self, tokens: list) -> int | None:
        """The value of the whole expression; None if it is no constant."""
        try:
            value, at = self._level(tokens, 0, 0)
        except (IndexError, ValueError, ZeroDivisionError, OverflowError):
            return None
        return value if at == len(tokens) else None

    def _level(self, t: list, at: int, level: int) -> tuple[int, int]:
        if level == len(self.LEVELS):
            return self._unit(t, at)
        value, at = self._level(t, at, level + 1)
        while at < len(t) and t[at][2] in self.LEVELS[level]:
            sign = t[at][2]
            other, at = self._level(t, at + 1, level + 1)
            if sign in ("<<", ">>") and not 0 <= other < 64:
                raise ValueError("no shift")
            value = {"|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "&": lambda a, b: a & b, "<<": lambda a, b: a << b, ">>": lambda a, b: a >> b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a // b, "%": lambda a, b: a % b}[sign](value, other)
        return value, at

    def _unit(self, t: list, at: int) -> tuple[int, int]:
        kind, text = t[at][1], t[at][2]
        if text == "(":
            close = _closing(t, at, "(", ")")
            inner = self.of(t[at + 1 : close])
            if inner is None:
                raise ValueError("no constant")
            return inner, close + 1
        if text == "sizeof":
            if t[at + 1][2] == "(":
                close = _closing(t, at + 1, "(", ")")
                return self._sizeof(t[at + 2 : close]), close + 1
            return self._sizeof(t[at + 1 : at + 2]), at + 2
        if kind == "number":
            digits = re.sub(r"[uUlL_]+$", "", text).replace("_", "")
            return int(digits, 8 if re.fullmatch(r"0[0-7]+", digits) else 0), at + 1
        if text in self.names:
            return self.names[text], at + 1
        raise ValueError("no constant")

    def _sizeof(self, t: list) -> int:
        words = [x[2] for x in t]
        if words and words[-1] == "*":
            return 8
        if len(words) == 1 and words[0] in self.capacities:
            return self.capacities[words[0]]
        known = [TYPES[w] for w in words if w in TYPES]
        if not known or any(w not in TYPES and w not in ("const", "signed", "struct") for w in words):
            raise ValueError("no known type")
        return known[-1]


def constants(text: str) -> dict[str, int]:
    """Integer macros of a file, in the order in which they are defined."""
    names: dict[str, int] = {}
    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+([^\n]+)$", text, re.M):
        value = Sizes(names, {}).of(list(tokenize(m[2], "c")))
        if value is not None:
            names[m[1]] = value
    return names


def _literal(token) -> int | None:
    """Bytes of a string literal without its end."""
    return len(re.sub(r"\\(?:x[0-9a-fA-F]+|[0-7]{1,3}|.)", ".", token[2][1:-1]).encode()) if token[1] == "string" and token[2][:1] == '"' else None


def _parts(tokens: list) -> list[list]:
    out, depth = [[]], 0
    for t in tokens:
        if t[2] == "," and depth == 0:
            out.append([])
        else:
            depth += (t[2] in "([{") - (t[2] in ")]}")
            out[-1].append(t)
    return out


def overflows(tokens: list, names: dict[str, int]):
    """(line, bytes written, capacity) of constant writes that do not fit their buffer, in one body."""
    capacities: dict[str, int] = {}
    contents: dict[str, int] = {}
    sizes = Sizes(names, capacities)
    for i, t in enumerate(tokens):
        after = tokens[i + 1][2] if i + 1 < len(tokens) else ""
        if t[1] == "identifier" and after == "[" and i and tokens[i - 1][2] in TYPES:
            close = _closing(tokens, i + 1, "[", "]")
            n = sizes.of(tokens[i + 2 : close])
            if n is not None and close + 1 < len(tokens) and tokens[close + 1][2] in (";", "=", ","):
                capacities[t[2]] = n * TYPES[tokens[i - 1][2]]
        elif t[1] == "identifier" and after == "=":
            end = next((k for k in range(i + 2, len(tokens)) if tokens[k][2] == ";"), len(tokens))
            value = tokens[i + 2 : end]
            called = next((k for k, x in enumerate(value[:-1]) if x[2] in HEAP and value[k + 1][2] == "("), None)
            if called is not None:
                args = _parts(value[called + 2 : _closing(value, called + 1, "(", ")")])
                given = [sizes.of(args[k]) if k < len(args) else None for k in HEAP[value[called][2]]]
                if None not in given:
                    capacities[t[2]] = given[0] * (given[1] if len(given) > 1 else 1)
                else:
                    capacities.pop(t[2], None)
            elif len(value) == 1 and _literal(value[0]) is not None:
                contents[t[2]] = _literal(value[0])
            elif len(value) == 1 and value[0][2] in capacities:
                capacities[t[2]] = capacities[value[0][2]]
            else:
                contents.pop(t[2], None)
                if tokens[i - 1][2] != "]":
                    capacities.pop(t[2], None)
        elif after == "(" and (t[2] in COUNTED or t[2] in COPIED):
            args = _parts(tokens[i + 2 : _closing(tokens, i + 1, "(", ")")])
            to, n = (COUNTED[t[2]][0], COUNTED[t[2]][1]) if t[2] in COUNTED else (0, COPIED[t[2]])
            if n >= len(args) or len(args[to]) != 1 or args[to][0][2] not in capacities:
                continue
            if t[2] in COUNTED:
                written = sizes.of(args[n])
            else:
                source = args[n][0] if len(args[n]) == 1 else None
                length = None if source is None else _literal(source) if _literal(source) is not None else contents.get(source[2])
                written = None if length is None or t[2] == "sprintf" and "%" in source[2] else length + 1
            if written is not None and written > capacities[args[to][0][2]]:
                yield t[3], written, capacities[args[to][0][2]]
