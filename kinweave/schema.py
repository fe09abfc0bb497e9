"""Table roles, attribute domains and foreign-key policies.

A schema names roles, their keys and their coded attributes; tables are DataFrames with those column names. Codes
are integers from 0 to size - 1. A chain is a line of roles, each but the first with a key of the role before it;
a star is a child with keys of two roots.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What happens to a row whose foreign key finds no parent.
POLICIES = ("drop", "first", "last", "zero", "error")


@dataclass(frozen=True)
class Role:
    """A table: its key column, its attributes with their domain sizes, and its foreign keys by parent role."""

    name: str
    key: str
    sizes: Mapping[str, int]
    parents: Mapping[str, str] = field(default_factory=dict)

    @property
    def attrs(self) -> tuple[str, ...]:
        return tuple(self.sizes)


@dataclass(frozen=True)
class Schema:
    """Roles by name; parents come before children."""

    roles: Mapping[str, Role]

    @classmethod
    def of(cls, *roles: Role) -> Schema:
        return cls({r.name: r for r in roles})

    @classmethod
    def chain(cls, *roles: Role) -> Schema:
        """Roles from the top down; each role's only foreign key is that of the role before it."""
        for up, down in zip(roles, roles[1:], strict=False):
            if tuple(down.parents) != (up.name,):
                raise ValueError(f"{down.name} must have {up.name} as its only parent")
        return cls.of(*roles)

    @classmethod
    def star(cls, root1: Role, child: Role, root2: Role) -> Schema:
        if tuple(child.parents) != (root1.name, root2.name):
            raise ValueError("the child's parents must be the two roots, in order")
        return cls.of(root1, root2, child)

    def size(self, role: str, attr: str) -> int:
        return self.roles[role].sizes[attr]

    def path(self, start: str, goal: str) -> list[str]:
        """Roles from start up to goal along foreign keys; raises if there is none."""
        if start == goal:
            return [start]
        for up in self.roles[start].parents:
            try:
                return [start, *self.path(up, goal)]
            except KeyError:
                continue
        raise KeyError(f"no foreign keys lead from {start} to {goal}")

    def checked(self, tables: Mapping[str, DataFrame]) -> None:
        """Raise ValueError if a table lacks a column that the schema names."""
        for r in self.roles.values():
            lacking = {r.key, *r.attrs, *r.parents.values()} - set(tables[r.name].columns)
            if lacking:
                raise ValueError(f"{r.name} lacks {sorted(lacking)}")


def clipped(x: Column, size: int) -> Column:
    """A code forced into its domain."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(size - 1))


#: The options that each kind of synthesis honours; others are refused, never ignored.
RAILS: Mapping[str, frozenset[str]] = {
    "chain2": frozenset("totals pubn bins tailbins rowleaf szsens szthresh exactmarg growcap".split()),
    "chain3": frozenset(
        "totals pubn bins tailbins rowleaf szsens szthresh exactmarg growcap ipf ratiotop repair szquota".split()
    ),
    "star": frozenset(
        "pubn bins tailbins rowleaf szsens szthresh exactmarg growcap repair szquota budget shrink".split()
    ),
}
