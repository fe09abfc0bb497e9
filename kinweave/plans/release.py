"""The one budgeted step: noisy marginals and size histograms of a chain or a star, as small dense arrays.

All rows are read by one aggregation for each role; the noise is drawn on every cell of the domains, empty ones
included; what comes back to the driver is bounded by the domains.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.accountant import (
    COUNT, SIZES, accepted_total, debiased, delta_of, equal_sigma, geometric_bins, hybrid_bins, split_sigmas,
)
from kinweave.functions.encode import size_bin
from kinweave.functions.noise import gaussian_value
from kinweave.functions.options import CrossHop, Options, cross_hop
from kinweave.operators.calibrate import shrunk_joint
from kinweave.operators.marginals import Marginal, domain_grid, marginals, on_grid, released
from kinweave.operators.sizes import all_sizes, capped, size_histogram, tau, with_weights
from kinweave.operators.views import column, view
from kinweave.schema import Schema


@dataclass
class Release:
    """Arrays by (role, attr) or pairs and triples of them; sizes by child role and parent attribute."""

    schema: Schema
    one: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    joint: dict[tuple, np.ndarray] = field(default_factory=dict)
    sizes: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    #: For each child role: the size that each bin stands for.
    reps: dict[str, list[int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    sigma: dict[str, float] = field(default_factory=dict)
    taus: dict[str, int] = field(default_factory=dict)
    cross: CrossHop = CrossHop()


#: Cells whose noise the driver draws; the domains of a release bound them, and more are drawn by the tasks.
CELLS = 300_000


def _arrays(
    cells: DataFrame, wanted: Sequence[Marginal], sizes: Mapping[str, int], sigma: Mapping[str, float] | None, seed: int
) -> dict[str, np.ndarray]:
    """Every object over its whole domain, with noise on every cell if there are scales.

    A cell's noise depends on its key alone, so it is the same wherever it is drawn.
    """
    out = {m.name: np.zeros(tuple(sizes[c] for c in m.columns)) for m in wanted}
    depth = {m.name: len(m.columns) for m in wanted}
    here = sum(x.size for x in out.values()) <= CELLS
    if not here:
        cells = on_grid(cells, domain_grid(sizes, wanted, cells.sparkSession))
        cells = released(cells, sigma, seed) if sigma else cells
    for name, *codes, value in cells.collect():
        out[name][tuple(codes[: depth[name]])] = value
    if here and sigma:
        for name, x in out.items():
            noise = [gaussian_value(seed, name, *k, *("~",) * (3 - len(k))) for k in np.ndindex(x.shape)]
            out[name] = np.maximum(x + sigma[name] * np.reshape(noise, x.shape), 0.0)
    return out


def release(
    schema: Schema, tables: Mapping[str, DataFrame], epsilon: float | None, options: Options | None = None, seed: int = 0,
    pairs: Sequence[
        tuple[tuple[str, str], tuple[str, str]]
    ] = (), triples: Sequence[tuple] = (), delta: float | None = None,
    exclude_sizes: Sequence[str] = (), cross: str | CrossHop = "inner",
) -> Release:
    """Release one-way marginals of all roles, the pairs and triples named, and size histograms.

    pairs and triples name (role, attribute) members; each is counted over the lowest role that it names. Rows of
    roles with parents weigh 1 / min(size of their group, tau), or 1 with `rowleaf`. `cross` says of pairs that skip a
    level whether they are released, whether they weigh by the weights of all levels between (both) or by the lowest
    one's alone (inner), and how synthesis guards their lifts. epsilon None adds no noise.
    """
    setting = cross if isinstance(cross, CrossHop) else cross_hop(cross)
    options = options or Options()
    out = Release(schema, cross=setting)
    if not setting.on:
        pairs = [p for p in pairs if not skips_level(schema, *p)]
    objects: dict[str, list[tuple[Marginal, tuple]]] = {r: [] for r in schema.roles}
    for r, role in schema.roles.items():
        objects[r] += [(Marginal(f"{r}.{a}", (column(r, a),)), ((r, a),)) for a in role.attrs]
    for members in [*pairs, *triples]:
        objects[_counted(schema, members)].append(
            (
                Marginal("*".join(f"{r}.{a}" for r, a in members), tuple(column(r, a) for r, a in members)),
                tuple(members),
            ),
        )
    bins: dict[str, tuple[list[int] | None, int]] = {}
    # What doesn't wait for each other runs side by side.
    pool = ThreadPoolExecutor(max_workers=8)
    below = [r for r, role in schema.roles.items() if role.parents]
    out.taus = dict(zip(below, pool.map(lambda r: tau(tables[r], next(iter(schema.roles[r].parents.values()))), below), strict=True))
    for r, role in schema.roles.items():
        if role.parents:
            fk = next(iter(role.parents.values()))
            if "bins" in options or "tailbins" in options:
                most = size_histogram(
                    tables[next(iter(role.parents))],
                    schema.roles[next(iter(role.parents))].key,
                    tables[r],
                    fk,
                ).agg(F.max("size")).first()[0] or 1
                edges, reps = (
                    geometric_bins(most, int(options.numbers("bins")[0]))
                    if "bins" in options
                    else hybrid_bins(out.taus[r], most, int(options.numbers("tailbins")[0]))
                )
                bins[r], out.reps[r] = (edges, len(edges)), reps
            else:
                bins[r], out.reps[r] = (None, out.taus[r] + 1), list(range(out.taus[r] + 1))
    size_objects = [
        (r, a) for r, role in schema.roles.items() if role.parents
        for a in schema.roles[next(iter(role.parents))].attrs if a not in exclude_sizes
    ]
    names = [m.name for own in objects.values() for m, _ in own]
    size_names = [f"SZ.{r}.{a}" for r, a in size_objects]
    counted = [*names, *size_names] + (["TOTALS"] * len(schema.roles) if "totals" in options else [])
    if epsilon is None:
        out.sigma = dict.fromkeys([*names, *size_names, "TOTALS"], 0.0)
    else:
        leaf = list(schema.roles)[-1]
        delta = delta or delta_of(max(2, tables[leaf].count()))
        each = equal_sigma(epsilon, delta, len(counted))
        out.sigma = dict.fromkeys([*names, *size_names, "TOTALS"], each)
        if "budget" in options:
            one = [m.name for own in objects.values() for m, k in own if len(k) == 1]
            joint = [n for n in [*names, *size_names] if n not in one]
            out.sigma |= split_sigmas(epsilon, delta, one, joint, *options.numbers("budget"))
        if "szsens" in options or "rowleaf" in options:
            out.sigma |= {n: out.sigma[n] * SIZES / COUNT for n in size_names}

    def counted(r: str) -> dict[str, np.ndarray]:
        own = objects[r]
        wanted = [m for m, _ in own]
        role = schema.roles[r]
        attrs = dict.fromkeys(k for _, members in own for k in members)
        source = dict(tables)
        weight = None
        if role.parents:
            fk = next(iter(role.parents.values()))
            source[r] = with_weights(tables[r], fk, out.taus[r], "w", "rowleaf" in options)
            weight = "w"
        sizes = {column(q, a): schema.size(q, a) for q, a in attrs}
        wide = view(schema, source, r, attrs, extra=[weight] if weight else [])
        far = [m for m, k in own if setting.weight == "both" and len(k) == 2 and len(schema.path(r, k[0][0])) > 2]
        cells = marginals(wide, [m for m in wanted if m not in far], weight)
        if far:
            up = next(iter(role.parents))
            above = with_weights(tables[up], next(iter(schema.roles[up].parents.values())), out.taus[up], "__above")
            keyed = above.select(F.col(schema.roles[up].key).alias("__up"), "__above")
            both = source[r].join(keyed, F.col(role.parents[up]) == F.col("__up")).drop("__up")
            both = both.withColumn("w", F.col("w") * F.col("__above")).drop("__above")
            cells = cells.unionByName(marginals(view(schema, source | {r: both}, r, attrs, extra=["w"]), far, "w"))
        return _arrays(cells, wanted, sizes, out.sigma if epsilon else None, seed)

    def grouped(r: str) -> dict[str, np.ndarray]:
        up = next(iter(schema.roles[r].parents))
        edges, width = bins[r]
        attrs = [a for q, a in size_objects if q == r]
        first = list(schema.roles).index(up) == 0 and edges is None
        rows = all_sizes(tables[up], schema.roles[up].key, tables[r], schema.roles[r].parents[up], attrs)
        rows = rows if first else rows.filter("n > 0")
        size = size_bin(F.col("n"), edges) if edges else capped(F.col("n"), out.taus[r])
        rows = rows.select(*(F.col(a).alias(column(up, a)) for a in attrs), size.alias("__size"))
        wanted = [Marginal(f"SZ.{r}.{a}", (column(up, a), "__size")) for a in attrs]
        sizes = {column(up, a): schema.size(up, a) for a in attrs} | {"__size": width}
        return _arrays(marginals(rows, wanted), wanted, sizes, out.sigma if epsilon else None, seed)

    arrays: dict[str, np.ndarray] = {}
    sized = list(dict.fromkeys(r for r, _ in size_objects))
    for job in [*(pool.submit(counted, r) for r in objects), *(pool.submit(grouped, r) for r in sized)]:
        arrays |= job.result()
    for own in objects.values():
        for m, members in own:
            if len(members) == 1:
                out.one[members[0]] = arrays[m.name]
            else:
                out.joint[members] = arrays[m.name]
    for r, a in size_objects:
        out.sizes[r, a] = arrays[f"SZ.{r}.{a}"]
    for r, a in size_objects:
        name, table = f"SZ.{r}.{a}", out.sizes[r, a]
        if "szthresh" in options:
            kappa = options.numbers("szthresh")[0]
            out.sizes[r, a] = np.array([debiased(x, out.sigma[name], kappa) for x in table])
    if "shrink" in options:
        for members, x in out.joint.items():
            if len(members) == 2:
                a, b = (out.one[m] for m in members)
                name = "*".join(f"{r}.{a}" for r, a in members)
                out.joint[members] = shrunk_joint(
                    x,
                    a,
                    b,
                    out.sigma[name],
                    options.numbers("shrink")[0],
                    float(x.sum()),
                )
    known = {"totals", "pubn"} & options.chosen.keys() or epsilon is None
    rows = dict(zip(schema.roles, pool.map(lambda r: tables[r].count(), schema.roles), strict=True)) if known else {}
    pool.shutdown()
    for r in schema.roles:
        n = rows.get(r)
        if n is not None and "totals" in options and epsilon is not None:
            fallback = float(np.mean([out.one[r, a].sum() for a in schema.roles[r].attrs]))
            n = accepted_total(n + out.sigma["TOTALS"] * gaussian_value(seed, "total", r), fallback)
        if n is not None:
            out.totals[r] = int(round(n))
    return out


def skips_level(schema: Schema, known: tuple[str, str], new: tuple[str, str]) -> bool:
    """Whether a pair joins a role to one that is not its own parent."""
    above = schema.roles[new[0]].parents
    return bool(above) and known[0] != new[0] and known[0] not in above


def _counted(schema: Schema, members: Sequence[tuple[str, str]]) -> str:
    """The first role, from the top, from which all members' roles can be reached."""
    for r in schema.roles:
        try:
            for q, _ in members:
                schema.path(r, q)
        except KeyError:
            continue
        return r
    raise ValueError(f"no role reaches all of {members}")
