"""The small language of synthesis options: tokens split by commas, with arguments behind colons."""

from __future__ import annotations

from dataclasses import dataclass, field

from kinweave.schema import RAILS

#: Tokens and how many numbers each may carry.
TOKENS = {
    "totals": 0, "pubn": 0, "bins": 1, "tailbins": 1, "rowleaf": 0, "szsens": 0, "szthresh": 1, "exactmarg": 0,
    "growcap": 0, "ipf": 0, "ratiotop": 0, "repair": 0, "szquota": 0, "budget": 2, "shrink": 1,
}
#: Numbers that a token has if none are given.
DEFAULTS = {"bins": (12.0,), "tailbins": (8.0,), "szthresh": (0.39894,), "budget": (1.0, 1.0), "shrink": (5.0,)}
#: Tokens that `all` leaves out.
NOT_IN_ALL = frozenset({"rowleaf", "budget", "shrink", "szquota", "bins"})


@dataclass(frozen=True)
class Options:
    """Chosen tokens and their numbers."""

    chosen: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def __contains__(self, token: str) -> bool:
        return token in self.chosen

    def numbers(self, token: str) -> tuple[float, ...]:
        return self.chosen.get(token) or DEFAULTS.get(token, ())

    def __str__(self) -> str:
        return ",".join(":".join([t, *(f"{x:g}" for x in n)]) for t, n in self.chosen.items()) or "off"


#: Names under which a cross-hop setting is known.
CROSS_NAMES = {
    "off": "off", "no": "off", "none": "off", "inner": "inner", "child": "inner", "single": "inner",
    "both": "both", "double": "both", "product": "both",
}


@dataclass(frozen=True)
class CrossHop:
    """Whether pairs across a level are released, how they weigh, and which guards their lifts have."""

    weight: str = "inner"
    guard_cell: bool = True
    guard_ancestor: bool = True

    @property
    def on(self) -> bool:
        return self.weight != "off"


def cross_hop(text: str = "inner") -> CrossHop:
    """Read `weight[:noguard|cell|ancestor]`; names have aliases, unknown ones raise ValueError."""
    name, _, guard = text.strip().lower().partition(":")
    if name not in CROSS_NAMES or guard not in ("", "noguard", "cell", "ancestor"):
        raise ValueError(f"unknown cross-hop setting {text!r}")
    return CrossHop(CROSS_NAMES[name], guard in ("", "cell"), guard in ("", "ancestor"))


def is_one_way(name: str) -> bool:
    """Whether an object of a release counts one attribute alone: names of joint objects hold * or begin with SZ."""
    return "*" not in name and not name.startswith("SZ.")


def parse(text: str, rail: str | None = None) -> Options:
    """Read options; unknown tokens, and those the rail doesn't honour, raise ValueError.

    `off` and an empty text choose nothing; `all` chooses every token but those in NOT_IN_ALL, or those of them
    that the rail honours. bins and tailbins exclude each other, as do totals and pubn.
    """
    chosen: dict[str, tuple[float, ...]] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, *rest = part.split(":")
        if name == "off":
            continue
        if name == "all":
            fine = RAILS[rail] if rail else TOKENS.keys()
            chosen |= {t: DEFAULTS.get(t, ()) for t in TOKENS if t in fine and t not in NOT_IN_ALL and t != "totals"}
            continue
        if name not in TOKENS or len(rest) > TOKENS[name]:
            raise ValueError(f"unknown option {part!r}")
        chosen[name] = tuple(map(float, rest)) or DEFAULTS.get(name, ())
    if rail and (odd := chosen.keys() - RAILS[rail]):
        raise ValueError(f"{rail} doesn't honour {sorted(odd)}")
    for pair in (("bins", "tailbins"), ("totals", "pubn")):
        if all(t in chosen for t in pair):
            raise ValueError(f"{pair[0]} and {pair[1]} exclude each other")
    return Options(chosen)
