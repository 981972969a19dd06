"""A record format that grows with the shapes it meets: each shape gets a plan, computed from leaf paths and types.

A leaf that the format has under the same path and type is taken as it is; one that is gone is looked for among the
shape's new leaves by the words of its path. Only a rename of one type, of names half alike, without a change of unit, goes
by itself; anything else waits for approval, and a record that lacks a core field is held. New leaves extend the format.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .umbrella import get_path

# Words of a name that tell a unit or a scale.
UNIT_WORDS = frozenset(("cents", "cent", "minor", "ms", "millis", "seconds", "sec", "minutes", "hours", "usd", "eur", "pln", "gbp", "kg", "g", "km", "m", "percent", "pct"))
ALIKE = 0.5


def words(path: str) -> set[str]:
    """Lower-case words and numbers of a dotted path."""
    return set(re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", path).lower()))


def alike(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return len(x & y) / max(1, len(x | y))


@dataclass(frozen=True)
class Field:
    name: str
    path: str
    type: str
    core: bool


@dataclass(frozen=True)
class Take:
    """Where a shape has a field of the format: ``held`` waits for approval, ``divide`` scales a number."""

    source: str | None
    kind: str  # same, rename, held, added
    divide: int | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Format:
    fields: tuple[Field, ...] = ()
    approved: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def seeded(cls, leaves: dict[str, str]) -> Format:
        """The format of the first shape, all of it core."""
        return cls(tuple(Field(p.replace(".", "_"), p, t, True) for p, t in sorted(leaves.items())))

    def plan(self, leaves: dict[str, str]) -> tuple[Format, dict[str, Take]]:
        """The format with what a shape (path: type) adds, and what each field takes from it."""
        new = {p: t for p, t in leaves.items() if not any(f.path == p and f.type == t for f in self.fields)}
        takes: dict[str, Take] = {}
        for f in sorted(self.fields, key=lambda f: f.path):
            if leaves.get(f.path) == f.type:
                takes[f.name] = Take(f.path, "same")
                continue
            score = lambda p: alike(f.path, p) + 0.15 * (new[p] == f.type) - 0.05 * abs(f.path.count(".") - p.count("."))  # noqa: B023, E731
            best = max(sorted(new), key=score, default=None)
            if best is None:
                takes[f.name] = Take(None, "held", reason="no_field")
                continue
            shift = (words(best) ^ words(f.path)) & UNIT_WORDS
            kind = new.pop(best)
            if kind == f.type and alike(f.path, best) >= ALIKE and not shift:
                takes[f.name] = Take(best, "rename")
                continue
            scaled = "cents" in words(best.rpartition(".")[2]) and "cents" not in words(f.name)
            takes[f.name] = Take(best, "held", 100 if scaled else None, "type" if kind != f.type else "unit" if shift else "name")
        names = {f.name for f in self.fields}
        added = tuple(Field(p.replace(".", "_"), p, t, False) for p, t in sorted(new.items()) if p.replace(".", "_") not in names)
        takes |= {f.name: Take(f.path, "added") for f in added}
        return replace(self, fields=self.fields + added), takes

    def approve(self, name: str) -> Format:
        return replace(self, approved=self.approved | {name})

    def record(self, document: dict, takes: dict[str, Take]) -> dict | None:
        """The record of a document by its shape's plan; None holds it until all core fields are there."""
        out: dict = {}
        for f in self.fields:
            take, value = takes.get(f.name), None
            if take and take.source and (take.kind != "held" or f.name in self.approved):
                try:
                    value = get_path(document, take.source)
                except KeyError:
                    value = None
                if take.divide and isinstance(value, (int, float)) and not isinstance(value, bool):
                    value = value / take.divide
            if value is None and f.core:
                return None
            out[f.name] = value
        return out
