"""Penalised maximum fit of the latent-trait model, by Newton steps over a table of regions.

Gives the posterior mode and the spread of the scores around it at given question
parameters; draws of a sampler, through ``summarise_draws``, give the rest.

The mode is sought in the scores themselves: ``alpha`` (regions), ``a`` (country walks)
and ``phi`` on the driver (logarithms of the two step sizes, first cutpoints and
logarithms of their gaps, logarithms of discriminations). Walk steps are differences of
scores over the step size, so this is the mode over steps as well. Positive parameters
have their prior on the logarithm, the scale on which a sampler moves: on their own
scale the density of the discriminations grows without a mode towards 0, since only
their proportions meet the data, and a step size of 0 would be a mode of any data.

Every region is a row that carries its cells and its score. One pass moves a row's score by
the last step, takes derivatives of its cells, and eliminates the region from the Newton
system by its small banded matrix over periods; only sums per country and over all come
out of it. The pass is narrow, its table is written to the shared folder and is the next
pass's input. The driver holds what belongs to countries and questions.

With P = inverse of region r's matrix, Q the precision of its walk, w its weight, X its
cross derivatives with ``phi``, l the pull of the national answers:

    d alpha = P (g + Q da - X dphi - w l),    l = h m + Xn dphi - gn,    m = sum of w d alpha

so ``da`` and ``l`` solve a system of twice the number of periods per country, given ``dphi``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pollspark.operators import scores as S
from pollspark.operators.relate import inner_join, left_join, union_all
from pollspark.session import materialise

#: Numbers of a batch's largest array; fewer regions are taken at a time where there are many questions.
BATCH = 1 << 21
#: Most that an entry of ``phi`` moves in a step; less after steps that had to be halved.
RADIUS = 1.0
#: Halvings of a step before the ascent gives up.
HALVINGS = 20
CELLS = "t array<int>, question array<int>, option array<int>, yes array<double>"
REGIONS = f"unit int, country int, wt double, {CELLS}, alpha array<double>, sums array<double>"


@dataclass(frozen=True)
class Design:
    """Sizes of the model; integer codes are dense from 1 in the tables and from 0 here."""

    periods: int
    kmin1: np.ndarray  # thresholds per question
    countries: int

    @property
    def questions(self) -> int:
        return len(self.kmin1)

    @property
    def cuts(self) -> int:
        return int(self.kmin1.max())

    @property
    def used(self) -> np.ndarray:
        return np.arange(1, self.cuts + 1)[None, :] <= self.kmin1[:, None]

    @property
    def items(self) -> int:
        """Discriminations, then cutpoints question by question."""
        return self.questions * (1 + self.cuts)

    @property
    def free(self) -> int:
        """Length of ``phi``."""
        return 2 + int(self.kmin1.sum()) + self.questions


@dataclass(frozen=True)
class Point:
    """Where the driver's part of the ascent stands."""

    a: np.ndarray  # countries x periods
    phi: np.ndarray


@dataclass(frozen=True)
class Step:
    da: np.ndarray
    pull: np.ndarray
    dphi: np.ndarray
    rate: float


def design(cells: DataFrame, nat: DataFrame, region_map: DataFrame) -> Design:
    """Read the sizes; the driver gets one number per question."""
    both = union_all(*[d.select("question_int", "option", "year_int") for d in (cells, nat)])
    periods = both.agg(F.max("year_int")).first()[0]
    countries = region_map.agg(F.max("iso_3166_int")).first()[0]
    limits = both.groupBy("question_int").agg((F.max("option") - 1).alias("k")).orderBy("question_int").collect()
    if [r[0] for r in limits] != list(range(1, len(limits) + 1)):
        raise ValueError("question codes must be dense from 1")
    return Design(int(periods), np.array([r[1] for r in limits], dtype=int), int(countries))


def _packed(cells: DataFrame, unit: str) -> DataFrame:
    """One row a unit with its cells as arrays; their number is bounded by periods, questions and options."""
    rows = cells.where(F.col("yes") > 0).select(
        F.col(unit).cast("int").alias("unit"),
        F.struct(
            (F.col("year_int") - 1).cast("int").alias("t"), (F.col("question_int") - 1).cast("int").alias("question"),
            F.col("option").cast("int").alias("option"), F.col("yes").cast("double").alias("yes"),
        ).alias("c"),
    )
    held = rows.groupBy("unit").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return held.select("unit", *[F.col(f"c.{n}").alias(n) for n in ("t", "question", "option", "yes")])


def region_rows(cells: DataFrame, region_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Every region with country, weight and packed cells, scores still null."""
    placed = inner_join(region_map, weights.select("regioncode_int", "wt"), ["regioncode_int"]).select(
        F.col("regioncode_int").cast("int").alias("unit"), (F.col("iso_3166_int") - 1).cast("int").alias("country"),
        F.col("wt").cast("double").alias("wt"),
    )
    rows = left_join(placed, _packed(cells, "regioncode_int"), ["unit"])
    filled = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("t", "question", "option", "yes")]
    none = F.lit(None).cast("array<double>")
    return rows.select("unit", "country", "wt", *filled, none.alias("alpha"), none.alias("sums"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


def cell_slopes(option, last, score, gamma, lower, upper) -> dict[str, np.ndarray]:
    """Log probability of an ordered answer and its first and second derivatives, without cancellation.

    Named by what they are taken in: s(core), g(amma), l(ower) and u(pper) cutpoint.
    """
    first = option == 1
    inside = ~(first | last)
    s_l, s_u = np.where(first, 0.0, score - lower), np.where(last, 0.0, score - upper)
    above, below = gamma * s_l, gamma * s_u
    gap = np.where(inside, above - below, 1.0)
    inner = np.where(inside, 1 / np.expm1(gap), 0.0)
    ll = (
        np.where(first, 0.0, _log_sigmoid(above)) + np.where(last, 0.0, _log_sigmoid(-below))
        + np.where(inside, np.log(-np.expm1(-gap)), 0.0)
    )
    a = np.where(first, 0.0, _sigmoid(-above) + inner)
    b = -np.where(last, 0.0, _sigmoid(below) + inner)
    ab = inner * (1 + inner)
    aa = -np.where(first, 0.0, _sigmoid(above) * _sigmoid(-above) + ab)
    bb = -np.where(last, 0.0, _sigmoid(below) * _sigmoid(-below) + ab)
    return {
        "": ll, "s": gamma * (a + b), "g": a * s_l + b * s_u, "l": -gamma * a, "u": -gamma * b,
        "ss": gamma**2 * (aa + 2 * ab + bb), "sg": a + b + gamma * ((aa + ab) * s_l + (ab + bb) * s_u),
        "sl": -(gamma**2) * (aa + ab), "su": -(gamma**2) * (ab + bb),
        "gg": aa * s_l**2 + 2 * ab * s_l * s_u + bb * s_u**2,
        "gl": -a - gamma * (aa * s_l + ab * s_u), "gu": -b - gamma * (ab * s_l + bb * s_u),
        "ll": gamma**2 * aa, "lu": gamma**2 * ab, "uu": gamma**2 * bb,
    }


def items_of(phi: np.ndarray, d: Design) -> dict[str, np.ndarray]:
    """Cutpoints and discriminations, centred and scaled, from the free vector."""
    n = int(d.kmin1.sum())
    free = np.zeros(d.used.shape)
    free[d.used] = phi[2 : 2 + n]
    gaps = np.exp(free)
    gaps[:, 0] = free[:, 0]
    raw = np.where(d.used, np.cumsum(np.where(d.used, gaps, 0.0), axis=1), 0.0)
    slope = np.where(d.kmin1 != 1, d.kmin1 - 1, 1)[:, None]
    loose = np.where(d.used, (2 * raw - (d.kmin1 + 1)[:, None]) / slope, 0.0)
    centre = np.mean(loose.sum(axis=1) / d.kmin1)
    log_g = phi[2 + n :]
    return {
        "gaps": gaps, "raw": raw, "slope": slope, "beta": np.where(d.used, loose - centre, 0.0),
        "gamma_raw": np.exp(log_g), "gamma": np.exp(log_g - log_g.mean()),
    }


def items_back(phi: np.ndarray, d: Design, by_item: np.ndarray, prior: bool = True) -> np.ndarray:
    """Slope in ``phi`` from the slope in discriminations and cutpoints, with that of their priors."""
    m, q = items_of(phi, d), d.questions
    g_gamma, g_beta = by_item[:q], by_item[q:].reshape(d.used.shape)
    g_loose = np.where(d.used, g_beta - g_beta[d.used].sum() / (q * d.kmin1[:, None]), 0.0)
    shift = np.where(d.used, m["raw"] - np.arange(1, d.cuts + 1)[None, :], 0.0)
    g_raw = np.where(d.used, g_loose * 2 / m["slope"] - prior * shift / m["slope"] ** 2, 0.0)
    chain = np.ones(d.used.shape)
    chain[:, 1:] = m["gaps"][:, 1:]
    ladder = np.cumsum(g_raw[:, ::-1], axis=1)[:, ::-1] * chain
    on_log = g_gamma * m["gamma"]
    shape, rate = S.GAMMA_PRIOR
    on_log = on_log - on_log.mean() + prior * (shape - rate * m["gamma_raw"])
    ladder[:, 1:] += prior
    return np.concatenate([[0.0, 0.0], ladder[d.used], on_log])


def items_prior(phi: np.ndarray, d: Design) -> float:
    m = items_of(phi, d)
    shift = np.where(d.used, m["raw"] - np.arange(1, d.cuts + 1)[None, :], 0.0)
    gaps = np.log(m["gaps"][:, 1:])[d.used[:, 1:]]
    shape, rate = S.GAMMA_PRIOR
    return float(-0.5 * np.sum((shift / m["slope"]) ** 2) + gaps.sum() + np.sum(shape * np.log(m["gamma_raw"]) - rate * m["gamma_raw"]))


def _columns(fn: Callable[[np.ndarray], np.ndarray], phi: np.ndarray, width: float = 1e-5) -> np.ndarray:
    """Jacobian of a driver-side function, one column for each entry of ``phi``."""
    out = []
    for i in range(len(phi)):
        e = np.zeros(len(phi))
        e[i] = width
        out.append((fn(phi + e) - fn(phi - e)) / (2 * width))
    return np.stack(out, axis=1)


def _by_item(phi: np.ndarray, d: Design) -> np.ndarray:
    m = items_of(phi, d)
    return np.concatenate([m["gamma"], m["beta"].ravel()])


def walk_precision(periods: int, start: float) -> np.ndarray:
    """Precision of a walk of unit steps whose first has the deviation ``start``; banded."""
    step = np.eye(periods) - np.eye(periods, k=-1)
    sd = np.ones(periods)
    sd[0] = start
    return step.T @ np.diag(sd**-2) @ step


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, period, question, option and count of all cells of a batch."""
    lengths = np.diff(batch.column("t").offsets.to_numpy())
    flat = [batch.column(c).flatten().to_numpy() for c in ("t", "question", "option", "yes")]
    return np.repeat(np.arange(batch.num_rows), lengths), *flat


def slot_sums(cells: tuple, score: np.ndarray, phi: np.ndarray, d: Design) -> dict[str, np.ndarray]:
    """Derivatives added up over the cells of ``score`` (units x periods).

    ``g`` and ``h`` in the scores (``h`` with the sign turned), ``cross`` with the items,
    ``item`` and ``items`` in the items alone, ``ll`` the log-likelihood.
    """
    row, t, j, option, yes = cells
    m, size, k = items_of(phi, d), d.items, d.cuts
    low, high = np.maximum(option - 2, 0), np.minimum(option - 1, k - 1)
    c = cell_slopes(option, option == d.kmin1[j] + 1, score[row, t], m["gamma"][j], m["beta"][j, low], m["beta"][j, high])
    c = {name: v * yes for name, v in c.items()}
    slot, slots = row * d.periods + t, score.size
    at = {"g": j, "l": d.questions + j * k + low, "u": d.questions + j * k + high}
    cross, item, items = np.zeros(slots * size), np.zeros(size), np.zeros(size * size)
    for x in "glu":
        cross += np.bincount(slot * size + at[x], c[f"s{x}"], slots * size)
        item += np.bincount(at[x], c[x], size)
        for y in "glu":
            items += np.bincount(at[x] * size + at[y], c[x + y if x + y in c else y + x], size * size)
    return {
        "ll": c[""].sum(), "g": np.bincount(slot, c["s"], slots).reshape(score.shape),
        "h": np.maximum(-np.bincount(slot, c["ss"], slots), 0.0).reshape(score.shape),
        "cross": cross.reshape(*score.shape, size), "item": item, "items": items.reshape(size, size),
    }


@dataclass(frozen=True)
class Local:
    """One region's part of the Newton system, for all regions of a batch."""

    g: np.ndarray  # regions x periods, likelihood and walk
    inverse: np.ndarray  # P
    x: np.ndarray  # regions x periods x phi
    q: np.ndarray
    e: np.ndarray
    sums: dict


def local_system(cells: tuple, alpha: np.ndarray, country: np.ndarray, at: Point, d: Design, jacobian: np.ndarray) -> Local:
    sums = slot_sums(cells, alpha, at.phi, d)
    q = walk_precision(d.periods, S.REGION_START_SD) * np.exp(-2 * at.phi[1])
    e = alpha - at.a[country]
    pulled = e @ q
    matrix = q[None] + sums["h"][:, :, None] * np.eye(d.periods)
    x = -(sums["cross"] @ jacobian)
    x[:, :, 1] -= 2 * pulled
    return Local(sums["g"] - pulled, np.linalg.inv(matrix), x, q, e, sums)


def moved(own: Local, country: np.ndarray, wt: np.ndarray, step: Step) -> np.ndarray:
    """The Newton step of each region's score."""
    rhs = own.g + step.da[country] @ own.q - own.x @ step.dphi - wt[:, None] * step.pull[country]
    return np.einsum("rij,rj->ri", own.inverse, rhs)


def _layout(d: Design) -> list[tuple[str, tuple[int, ...]]]:
    """What a country's sums hold."""
    t, p = d.periods, d.free
    return [("n", (1,)), ("e", (t,)), ("wx", (t,)), ("s0", (t,)), ("s1", (t, t)), ("s2", (t, p)), ("s3", (t, t)), ("r0", (t,)), ("r1", (t, t)), ("r2", (t, p))]


def _layout_all(d: Design) -> list[tuple[str, tuple[int, ...]]]:
    p, i = d.free, d.items
    return [("ll", (1,)), ("eqe", (1,)), ("item", (i,)), ("items", (i, i)), ("t0", (p,)), ("t2", (p, p))]


def _unpacked(flat: np.ndarray, layout: list) -> dict[str, np.ndarray]:
    ends = np.cumsum([int(np.prod(shape)) for _, shape in layout])
    return {name: part.reshape(shape) for (name, shape), part in zip(layout, np.split(flat, ends[:-1]), strict=True)}


def region_pass(state: DataFrame, before: Point, step: Step | None, now: Point, d: Design) -> DataFrame:
    """All regions moved from ``before`` by ``step`` (or put on the country's walk), and the sums at ``now``.

    Rows of ``REGIONS``; those with ``sums`` are a batch's sums, of a country or (``country`` -1) of all.
    """
    schema = to_arrow_schema(StructType.fromDDL(REGIONS))
    jac_before, jac_now = (_columns(lambda f: _by_item(f, d), p.phi) for p in (before, now))
    rows = max(1, BATCH // (d.periods * max(d.items, d.free, d.periods)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, rows):
            cells, n = _cells_of(batch), batch.num_rows
            country, wt = batch.column("country").to_numpy(), batch.column("wt").to_numpy()
            if step is None:
                alpha = now.a[country]
            else:
                alpha = batch.column("alpha").flatten().to_numpy().reshape(n, d.periods)
                alpha = alpha + step.rate * moved(local_system(cells, alpha, country, before, d, jac_before), country, wt, step)
            own = local_system(cells, alpha, country, now, d, jac_now)
            offsets = np.arange(n + 1, dtype=np.int32) * d.periods
            scores = pa.ListArray.from_arrays(offsets, alpha.ravel())
            kept = [batch.column(c) for c in ("unit", "country", "wt", "t", "question", "option", "yes")]
            yield pa.RecordBatch.from_arrays([*kept, scores, pa.nulls(n, pa.list_(pa.float64()))], schema=schema)
            codes, place = np.unique(country, return_inverse=True)

            def by_country(values: np.ndarray, place=place, size=len(codes)) -> np.ndarray:
                out = np.zeros((size, *values.shape[1:]))
                np.add.at(out, place, values)
                return out.reshape(size, -1)

            pg, pq, px = np.einsum("rij,rj->ri", own.inverse, own.g), own.inverse @ own.q, own.inverse @ own.x
            w1, w2 = wt[:, None], wt[:, None, None]
            parts = [
                np.ones((n, 1)), own.e, w1 * alpha, w1 * pg, w2 * pq, w2 * px, w2**2 * own.inverse, pg @ own.q, own.q @ pq, own.q @ px
            ]
            sums = list(np.concatenate([by_country(p) for p in parts], axis=1))
            total = [
                own.sums["ll"], np.sum(own.e @ own.q * own.e), own.sums["item"], own.sums["items"],
                np.einsum("rtp,rt->p", own.x, pg), np.einsum("rtp,rtq->pq", own.x, px),
            ]
            sums.append(np.concatenate([np.ravel(x) for x in total]))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(sums), pa.int32()), pa.array([*codes, -1], pa.int32()), pa.nulls(len(sums), pa.float64()),
                 *[pa.nulls(len(sums), f.type) for f in list(schema)[3:8]], pa.array(sums, pa.list_(pa.float64()))], schema=schema,
            )

    return materialise(state.where("sums IS NULL").mapInArrow(run, REGIONS))


def added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by country, entry by entry; the driver gets one row for each."""
    schema = to_arrow_schema(StructType.fromDDL("country int, sums array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = batch.column(1)[i].values.to_numpy()
                held[key] = held[key] + own if key in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], schema=schema)

    dealt = rows.where("sums IS NOT NULL").select("country", "sums").repartition("country")
    return {r[0]: np.array(r[1]) for r in dealt.mapInArrow(run, "country int, sums array<double>").collect()}


def national_pass(nations: DataFrame, score: np.ndarray, phi: np.ndarray, d: Design) -> tuple[dict, dict[str, np.ndarray]]:
    """``g``, ``h`` and ``x`` of each country with national cells, and what they add to the items."""
    jac = _columns(lambda f: _by_item(f, d), phi)
    t, p, i = d.periods, d.free, d.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, max(1, BATCH // (t * max(i, p)))):
            unit = batch.column("unit").to_numpy() - 1
            sums = slot_sums(_cells_of(batch), score[unit], phi, d)
            x = -(sums["cross"] @ jac)
            rows = [np.concatenate([sums["g"][k], sums["h"][k], x[k].ravel()]) for k in range(len(unit))]
            rows.append(np.concatenate([[sums["ll"]], sums["item"], sums["items"].ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array([*unit, -1], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["country", "sums"])

    found = added(nations.mapInArrow(run, "country int, sums array<double>"))
    total = _unpacked(found.pop(-1, np.zeros(1 + i + i * i)), [("ll", (1,)), ("item", (i,)), ("items", (i, i))])
    return {c: _unpacked(v, [("g", (t,)), ("h", (t,)), ("x", (t, p))]) for c, v in found.items()}, total


@dataclass(frozen=True)
class System:
    """The Newton system of countries and ``phi``, regions eliminated."""

    value: float
    countries: dict[int, tuple]  # matrix, affine right side (constant, in phi), and what enters the equation of phi
    g_phi: np.ndarray
    h_phi: np.ndarray
    slope: float


def assemble(state: DataFrame, nations: DataFrame, at: Point, d: Design) -> System:
    sums = added(state)
    total = _unpacked(sums.pop(-1), _layout_all(d))
    own = {c: _unpacked(v, _layout(d)) for c, v in sums.items()}
    t, p = d.periods, d.free
    score = np.zeros((d.countries, t))
    for c, s in own.items():
        score[c] = s["wx"]
    national, nat = national_pass(nations, score, at.phi, d)
    jac = _columns(lambda f: _by_item(f, d), at.phi)
    item, items = total["item"] + nat["item"], total["items"] + nat["items"]
    g_phi = items_back(at.phi, d, item)
    # Second order: through the items' own curvature, and through that of their form and priors.
    h_phi = -(jac.T @ items @ jac) - _columns(lambda f: items_back(f, d, item), at.phi)
    value = float(total["ll"][0] + nat["ll"][0]) + items_prior(at.phi, d)
    qc = walk_precision(t, S.COUNTRY_START_SD) * np.exp(-2 * at.phi[0])
    q = walk_precision(t, S.REGION_START_SD) * np.exp(-2 * at.phi[1])
    walks = np.einsum("ci,ij,cj->", at.a, qc, at.a), float(total["eqe"][0])
    for i, (walk, (shape, rate)) in enumerate(zip(walks, (S.COUNTRY_STEP_PRIOR, S.REGION_STEP_PRIOR), strict=True)):
        size = np.exp(at.phi[i])
        value += -0.5 * walk + shape * at.phi[i] - rate * size
        g_phi[i] = walk + shape - rate * size
        h_phi[i, i] += 2 * walk + rate * size
    parts, slope = {}, float(np.abs(g_phi).max())
    g_phi, h_phi = g_phi - total["t0"], h_phi - total["t2"]
    none = {"g": np.zeros(t), "h": np.zeros(t), "x": np.zeros((t, p))}
    for c in range(d.countries):
        s = own.get(c) or _unpacked(np.zeros(sum(int(np.prod(z)) for _, z in _layout(d))), _layout(d))
        n = national.get(c, none)
        g_a = -qc @ at.a[c] + q @ s["e"]
        x_a = np.zeros((t, p))
        x_a[:, 0], x_a[:, 1] = -2 * qc @ at.a[c], 2 * q @ s["e"]
        h = n["h"][:, None]
        matrix = np.block([[qc + s["n"][0] * q - s["r1"], s["s1"].T], [-h * s["s1"], np.eye(t) + h * s["s3"]]])
        right = np.concatenate([g_a + s["r0"], n["h"] * s["s0"] - n["g"]])
        in_phi = np.concatenate([-(x_a + s["r2"]), n["x"] - h * s["s2"]])
        enters = np.concatenate([x_a + s["r2"] + s["s1"].T @ n["x"], -(s["s2"] + s["s3"] @ n["x"])])
        g_phi = g_phi - n["x"].T @ s["s0"]
        h_phi = h_phi - n["x"].T @ s["s2"]
        parts[c] = (matrix, right, in_phi, enters, s, n)
        slope = max(slope, float(np.abs(g_a).max()))
    return System(float(value), parts, g_phi, h_phi, slope)


def newton(system: System, d: Design, radius: float) -> Step:
    """The step, shortened so that no entry of ``phi`` moves by more than ``radius``."""
    g, h, solved = system.g_phi.copy(), system.h_phi.copy(), {}
    for c, (matrix, right, in_phi, enters, *_) in system.countries.items():
        both = np.linalg.solve(matrix, np.column_stack([right, in_phi]))
        solved[c] = both
        g -= enters.T @ both[:, 0]
        h += enters.T @ both[:, 1:]
    # Away from the mode the curvature may have a wrong sign in some direction; its size then serves.
    values, axes = np.linalg.eigh((h + h.T) / 2)
    dphi = axes @ ((axes.T @ g) / np.maximum(np.abs(values), 1e-8 * np.abs(values).max()))
    both = np.stack([solved[c][:, 0] + solved[c][:, 1:] @ dphi for c in range(d.countries)])
    t = d.periods
    return Step(both[:, :t], both[:, t:], dphi, min(1.0, radius / max(np.abs(dphi).max(), 1e-300)))


def start(d: Design) -> Point:
    """Flat walks, evenly spaced cutpoints, equal discriminations."""
    first = np.zeros(d.used.shape)
    first[:, 0] = 1.0
    phi = np.concatenate([[np.log(0.25), np.log(0.1)], first[d.used], np.zeros(d.questions)])
    return Point(np.zeros((d.countries, d.periods)), phi)


def spread(state: DataFrame, system: System, at: Point, d: Design) -> DataFrame:
    """``(unit, country, alpha, sd, slope)`` of every region: score, its deviation at given ``phi``, greatest slope.

    The region's block of the inverse: its own P, and what reaches it through its country.
    """
    inverse = np.stack([np.linalg.inv(system.countries[c][0]) for c in range(d.countries)])
    g_n, h_n = (np.stack([system.countries[c][5][k] for c in range(d.countries)]) for k in "gh")
    jac = _columns(lambda f: _by_item(f, d), at.phi)
    rows = max(1, BATCH // (d.periods * max(d.items, d.free, d.periods)))
    schema = "unit int, country int, alpha array<double>, sd array<double>, slope double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, rows):
            n = batch.num_rows
            country, wt = batch.column("country").to_numpy(), batch.column("wt").to_numpy()
            alpha = batch.column("alpha").flatten().to_numpy().reshape(n, d.periods)
            own = local_system(_cells_of(batch), alpha, country, at, d, jac)
            pq, wp = own.inverse @ own.q, wt[:, None, None] * own.inverse
            reach = inverse[country] @ np.concatenate([pq.transpose(0, 2, 1), h_n[country][:, :, None] * wp], axis=1)
            covered = own.inverse + np.concatenate([pq, -wp], axis=2) @ reach
            sd = np.sqrt(np.maximum(np.einsum("rii->ri", covered), 0.0))
            slope = np.abs(own.g + wt[:, None] * g_n[country]).max(axis=1)
            offsets = np.arange(n + 1, dtype=np.int32) * d.periods
            arrays = [batch.column("unit"), batch.column("country"), batch.column("alpha"), pa.ListArray.from_arrays(offsets, sd.ravel()), pa.array(slope)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return materialise(state.where("sums IS NULL").mapInArrow(run, schema))


def national_scores(system: System, d: Design) -> tuple[np.ndarray, np.ndarray]:
    """Poststratified scores and their deviations at given ``phi``."""
    score, sd = np.zeros((d.countries, d.periods)), np.zeros((d.countries, d.periods))
    for c, (matrix, _, _, _, s, n) in system.countries.items():
        score[c] = s["wx"]
        reach = np.linalg.solve(matrix, np.concatenate([s["s1"].T, n["h"][:, None] * s["s3"]]))
        sd[c] = np.sqrt(np.maximum(np.diag(s["s3"] + np.hstack([s["s1"], -s["s3"]]) @ reach), 0.0))
    return score, sd


@dataclass(frozen=True)
class Fit:
    """The mode. ``regions``: unit, country, alpha, sd, slope, one row a region."""

    design: Design
    at: Point
    system: System
    regions: DataFrame
    settled: bool
    passes: int

    def region_scores(self) -> DataFrame:
        """``(regioncode_int, iso_3166_int, year_int, mean, sd)``."""
        pairs = F.posexplode(F.arrays_zip("alpha", "sd")).alias("t", "p")
        return self.regions.select(F.col("unit").alias("regioncode_int"), (F.col("country") + 1).alias("iso_3166_int"), pairs).select(
            "regioncode_int", "iso_3166_int", (F.col("t") + 1).alias("year_int"), F.col("p.alpha").alias("mean"), F.col("p.sd").alias("sd")
        )

    def national_scores(self) -> DataFrame:
        """``(iso_3166_int, year_int, mean, sd)``."""
        score, sd = national_scores(self.system, self.design)
        rows = [(c + 1, t + 1, float(v), float(sd[c, t])) for (c, t), v in np.ndenumerate(score)]
        return self.regions.sparkSession.createDataFrame(rows, "iso_3166_int int, year_int int, mean double, sd double")

    def variables(self) -> DataFrame:
        """``(variable, value)``, variables named as in a parameter summary."""
        d, m, spark = self.design, items_of(self.at.phi, self.design), self.regions.sparkSession
        steepest = self.regions.agg(F.max("slope")).first()[0] or 0.0
        rows = [
            ("lp__", self.system.value), ("slope__", max(self.system.slope, steepest)), ("converged__", float(self.settled)),
            ("passes__", float(self.passes)), ("country_step", float(np.exp(self.at.phi[0]))), ("region_step", float(np.exp(self.at.phi[1]))),
        ]
        rows += [(f"gamma[{j + 1}]", float(v)) for j, v in enumerate(m["gamma"])]
        rows += [(f"beta[{j + 1},{k + 1}]", float(v)) for (j, k), v in np.ndenumerate(m["beta"]) if d.used[j, k]]

        def named(df: DataFrame, name: str, unit: str) -> DataFrame:
            return df.select(F.format_string(f"{name}[%d,%d]", unit, "year_int").alias("variable"), F.col("mean").alias("value"))

        return union_all(
            spark.createDataFrame(rows, "variable string, value double"),
            named(self.national_scores(), "country_poststrat", "iso_3166_int"),
            named(self.region_scores(), "region_alpha", "regioncode_int"),
        )


def fit(
    cells: DataFrame, nat: DataFrame, region_map: DataFrame, weights: DataFrame, iters: int = 100, tol: float = 1e-10,
    begin: Callable[[Design], Point] = start,
) -> Fit:
    """Posterior mode by Newton steps with step halving.

    ``cells``: regioncode_int, iso_3166_int, year_int, question_int, option, yes;
    ``nat`` the same without region. ``region_map``: regioncode_int, iso_3166_int.
    ``weights``: regioncode_int, wt. It has settled when a whole step gains less than
    ``tol`` of the value and moves no parameter by 1e-5.
    """
    d = design(cells, nat, region_map)
    rows, nations = region_rows(cells, region_map, weights), materialise(_packed(nat, "iso_3166_int"))
    at = begin(d)
    state = region_pass(rows, at, None, at, d)
    system, settled, passes, radius = assemble(state, nations, at, d), False, 1, RADIUS
    for _ in range(iters):
        step = newton(system, d, radius)
        for tries in range(HALVINGS):
            after = Point(at.a + step.rate * step.da, at.phi + step.rate * step.dphi)
            moved_state = region_pass(state, at, step, after, d)
            trial = assemble(moved_state, nations, after, d)
            passes += 1
            if trial.value >= system.value - 1e-12 * (1 + abs(system.value)):
                break
            step = replace(step, rate=step.rate / 2)
        else:
            break
        gain = trial.value - system.value
        length = step.rate * np.abs(step.dphi).max()
        radius = min(RADIUS, length if tries else 2 * max(length, radius))
        at, state, system = after, moved_state, trial
        settled = step.rate == 1 and gain < tol * (1 + abs(system.value)) and max(np.abs(step.da).max(), np.abs(step.dphi).max()) < 1e-5
        if settled:
            break
    return Fit(d, at, system, spread(state, system, at, d), settled, passes)


def fit_map(cells: DataFrame, nat: DataFrame, region_map: DataFrame, weights: DataFrame, iters: int = 100) -> DataFrame:
    """``(variable, value)`` of the posterior mode; see ``fit`` for the tables.

    ``converged__`` is 1 only if the ascent settled within ``iters`` steps, ``slope__``
    is the greatest slope where it ended and ``passes__`` the number of passes over the cells.
    """
    return fit(cells, nat, region_map, weights, iters).variables()


def cell_gradient(cells: DataFrame, scores: DataFrame, score: str, on: Sequence[str], gamma: DataFrame, beta: DataFrame) -> DataFrame:
    """Cells with ``loglik`` and its slopes ``d_score``, ``d_gamma``, ``d_lower``, ``d_upper``, times their count.

    Column expressions only. The tables are those of ``cell_probabilities``; the first
    option has no lower cutpoint and the last no upper one, their slopes are 0.
    """
    cuts = beta.groupBy("question").agg(F.map_from_entries(F.array_agg(F.struct(F.col("k").cast("int"), "beta"))).alias("__cuts"))
    items = inner_join(gamma.select("question", F.col("gamma").alias("__gamma"), F.col("kmin1").alias("__last")), cuts, ["question"])
    joined = inner_join(inner_join(cells, items, ["question"]), scores.select(*on, F.col(score).alias("__score")), list(on))
    option, g, zero = F.col("option").cast("int"), F.col("__gamma"), F.lit(0.0)
    first, last = option == 1, option == F.col("__last") + 1

    def sigmoid(x: Column) -> Column:
        return 0.5 * (1 + F.tanh(0.5 * x))

    def log_sigmoid(x: Column) -> Column:
        return -(F.greatest(-x, zero) + F.log1p(F.exp(-F.abs(x))))

    s_low, s_up = F.col("__score") - F.try_element_at("__cuts", option - 1), F.col("__score") - F.try_element_at("__cuts", option)
    above, below = g * s_low, g * s_up
    gap = above - below
    inner = F.when(first | last, zero).otherwise(1 / F.expm1(gap))
    a = F.when(first, zero).otherwise(sigmoid(-above) + inner)
    b = F.when(last, zero).otherwise(-(sigmoid(below) + inner))
    ll = (
        F.when(first, zero).otherwise(log_sigmoid(above)) + F.when(last, zero).otherwise(log_sigmoid(-below))
        + F.when(first | last, zero).otherwise(F.log(-F.expm1(-gap)))
    )
    d_gamma = F.when(first, zero).otherwise(a * s_low) + F.when(last, zero).otherwise(b * s_up)
    yes = F.col("yes").cast("double")
    found = {"loglik": ll, "d_score": g * (a + b), "d_gamma": d_gamma, "d_lower": -g * a, "d_upper": -g * b}
    return joined.select(*cells.columns, *[(yes * c).alias(n) for n, c in found.items()])


def score_gradient(
    cells: DataFrame, scores: DataFrame, score: str, on: list[str], gamma: DataFrame, beta: DataFrame
) -> DataFrame:
    """``(on, loglik, d_score)``: log-likelihood and its slope in each score, added up before the shuffle."""
    return cell_gradient(cells, scores, score, on, gamma, beta).groupBy(*on).agg(*[F.sum(c).alias(c) for c in ("loglik", "d_score")])


def item_gradient(slopes: DataFrame) -> DataFrame:
    """``(question, k, slope)`` from ``cell_gradient``: in each cutpoint ``k``, and with null ``k`` in the discrimination."""
    option = F.col("option").cast("int")
    each = F.explode(F.array(
        F.struct(F.lit(None).cast("int").alias("k"), F.col("d_gamma").alias("d"), F.lit(True).alias("held")),
        F.struct((option - 1).alias("k"), F.col("d_lower").alias("d"), (F.col("d_lower") != 0).alias("held")),
        F.struct(option.alias("k"), F.col("d_upper").alias("d"), (F.col("d_upper") != 0).alias("held")),
    ))
    rows = slopes.select("question", each.alias("s")).where("s.held").select("question", "s.k", "s.d")
    return rows.groupBy("question", "k").agg(F.sum("d").alias("slope"))


def step_gradient(slopes: DataFrame, walk: str) -> DataFrame:
    """One row ``slope``: in the logarithm of a step size, which scales the column ``walk`` of ``score_gradient`` rows."""
    return slopes.agg(F.sum(F.col("d_score") * F.col(walk)).alias("slope"))
