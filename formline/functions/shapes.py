"""Shapes of JSON values: what is left when values are erased, in canonical form.

A shape is a tuple that compares as shapes do: its kind first, then its parts. Arrays hold the
sorted set of their elements' shapes and whether they had elements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from .strictjson import Array, Number

NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT = range(6)
EMPTY, NONEMPTY, PARTIAL = range(3)

# Names of scalar kinds and of what arrays hold, in canonical form.
_SCALARS = {NULL: "null", BOOL: "bool", NUMBER: "num", STRING: "str"}
_HELD = {EMPTY: "empty", NONEMPTY: "nonempty", PARTIAL: "partial"}

Shape = tuple


def shape_of(node: object) -> Shape:
    if node is None:
        return (NULL,)
    if isinstance(node, bool):
        return (BOOL,)
    if isinstance(node, Number):
        return (NUMBER,)
    if isinstance(node, str):
        return (STRING,)
    if isinstance(node, dict):
        return (OBJECT, tuple((k, shape_of(node[k])) for k in sorted(node)))
    held = PARTIAL if isinstance(node, Array) and node.truncated else NONEMPTY if node else EMPTY
    return (ARRAY, tuple(sorted({shape_of(x) for x in node})), held)


def quoted(text: str) -> str:
    """A JSON string with the least escapes: quote, backslash and controls as four hex digits."""
    return '"' + "".join("\\" + c if c in '"\\' else f"\\u{ord(c):04x}" if c < " " else c for c in text) + '"'


def canonical(shape: Shape) -> str:
    kind = shape[0]
    if kind in _SCALARS:
        return f'{{"t":"{_SCALARS[kind]}"}}'
    if kind == ARRAY:
        return f'{{"t":"arr","e":"{_HELD[shape[2]]}","of":[{",".join(map(canonical, shape[1]))}]}}'
    return '{"t":"obj","f":{' + ",".join(f"{quoted(k)}:{canonical(v)}" for k, v in shape[1]) + "}}"


def depth(shape: Shape) -> int:
    if shape[0] == ARRAY:
        return 1 + max(map(depth, shape[1]), default=0)
    if shape[0] == OBJECT:
        return 1 + max((depth(v) for _, v in shape[1]), default=0)
    return 1


def top_keys(shape: Shape) -> list[str]:
    return [k for k, _ in shape[1]] if shape[0] == OBJECT else []


# Observations of a document's nodes, one row each, which aggregation merges into profiles.

NEGATIVE, ZERO, SMALL, MEDIUM, LARGE = 1, 2, 4, 8, 16


def number_bucket(text: str) -> int:
    x = float(text)
    if x < 0:
        return NEGATIVE
    if x == 0:
        return ZERO
    return SMALL if x <= 10 else MEDIUM if x <= 100 else LARGE


_KINDS = {type(None): NULL, bool: BOOL, Number: NUMBER, str: STRING, Array: ARRAY, list: ARRAY, dict: OBJECT}


def occurrences(node: object, path: str = "", parent: str | None = None) -> Iterator[tuple]:
    """(path, parent, kind, empty, partial, integer, negative zero, bucket mask) of a value and all below it.

    A path is the steps from the root, each after a slash: keys with ``~`` and ``/`` escaped as in
    JSON pointers, and ``~*`` for the elements of an array.
    """
    kind = _KINDS[type(node)]
    if kind == NUMBER:
        whole = not any(c in node for c in ".eE")
        minus = node.startswith("-") and float(node) == 0
        yield path, parent, kind, False, False, whole, minus, number_bucket(node)
        return
    partial = kind == ARRAY and getattr(node, "truncated", False)
    yield path, parent, kind, kind == ARRAY and not node and not partial, partial, True, False, 0
    if kind == OBJECT:
        for key, x in node.items():
            yield from occurrences(x, f"{path}/{key.replace('~', '~0').replace('/', '~1')}", path)
    elif kind == ARRAY:
        for x in node:
            yield from occurrences(x, f"{path}/~*", path)


def shape_nodes(node: dict, path: str = "", parent: str | None = None) -> Iterator[tuple]:
    """(path, parent, kind, empty, partial) of a canonical shape, decoded from JSON, and all below it."""
    kind = {"null": NULL, "bool": BOOL, "num": NUMBER, "str": STRING, "arr": ARRAY, "obj": OBJECT}[node["t"]]
    yield path, parent, kind, node.get("e") == "empty", node.get("e") == "partial"
    for key, x in node.get("f", {}).items():
        yield from shape_nodes(x, f"{path}/{key.replace('~', '~0').replace('/', '~1')}", path)
    for x in node.get("of", ()):
        yield from shape_nodes(x, f"{path}/~*", path)


# Generalised schemas, from the merged counts of a profile's paths.

# Types in the order of the canonical form, with their kind.
_TYPES = (("array", ARRAY), ("bool", BOOL), ("null", NULL), ("number", NUMBER), ("object", OBJECT), ("string", STRING))


def unescape(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~")


def generalized(paths: dict[str, tuple[int, ...]], documents: int) -> str:
    """Canonical form of a profile: ``paths`` maps each path to its counts by kind."""
    below: dict[str, list[str]] = {}
    for p in paths:
        if p:
            below.setdefault(p.rpartition("/")[0], []).append(p)

    def field(path: str, most: int) -> str:
        counts = paths[path]
        types = ",".join(f'"{name}"' for name, kind in _TYPES if counts[kind])
        out = f'{{"optional":{"true" if sum(counts) < most else "false"},"types":[{types}]'
        keys = sorted((unescape(p.rpartition("/")[2]), p) for p in below.get(path, ()) if not p.endswith("/~*"))
        if keys:
            out += ',"children":{' + ",".join(f"{quoted(k)}:{field(p, counts[OBJECT])}" for k, p in keys) + "}"
        if f"{path}/~*" in paths:
            out += f',"elem":{field(f"{path}/~*", counts[ARRAY])}'
        return out + "}"

    return field("", documents)


def structural_tokens(paths: dict[str, tuple[int, ...]]) -> list[str]:
    """``label:type`` of every path: the root ``$``, keys joined by points, elements ``[]``."""
    out = []
    for p, counts in paths.items():
        label = ""
        for step in p.split("/")[1:]:
            label = f"{label}[]" if step == "~*" else f"{label}.{unescape(step)}" if label else unescape(step)
        out += [f"{label or '$'}:{name}" for name, kind in _TYPES if counts[kind]]
    return out


def field_band(n: int) -> int:
    """0, or the least power of two that is no smaller."""
    return 0 if n == 0 else 1 << math.ceil(math.log2(n)) if n > 1 else 1
