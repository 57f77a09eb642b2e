"""Random-intercept and penalised-spline models with their summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.session import settle
from ectolog.stats.blocks import Parts, Sums, block_sums, by_individual, individual_parts, predict_cells, predict_fixed
from ectolog.stats.design import Design, curvature
from ectolog.stats.tails import _t_ppf, f_sf, range_sf, t_two_sided
from ectolog.stats.wald import smooth_wald

Z95 = 1.959963984540054


@dataclass
class Fit:
    """A fitted model: small matrices only, plus what is needed to predict."""

    design: Design
    names: list[str]
    coef: np.ndarray
    hinv: np.ndarray
    sigma2: float
    n: int
    ids: int
    reml: float
    edf: float
    rss: float
    null_dev: float
    center: float
    smooth_penalty: float
    id_col: str | None = None
    kind: str | None = None
    cells: DataFrame | None = None
    block_penalty: np.ndarray | None = None
    block_edf: float = 0.0
    edge: str | None = None
    between: tuple[str, ...] = ()

    @property
    def cov(self) -> np.ndarray:
        return self.sigma2 * self.hinv

    @property
    def var_id(self) -> float:
        """Variance of the random intercept; exactly 0 where the criterion only falls towards 0."""
        if self.kind != "intercept":
            return float("nan")
        if self.edge == "none":
            return 0.0
        return self.sigma2 / float(self.block_penalty[0, 0])

    @property
    def aic(self) -> float:
        return self.n * np.log(2 * np.pi * self.rss / self.n) + self.n + 2 * (self.edf + 1)

    @property
    def beta(self) -> np.ndarray:
        """Coefficients on the scale of y (the fit itself is centred)."""
        out = self.coef.copy()
        out[0] += self.center
        return out

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The fit as plain tables, for :func:`ectolog.sources.save_model`."""
        se = np.sqrt(np.diag(self.cov))
        coef = [(t, float(b), float(s)) for t, b, s in zip(self.names, self.beta, se, strict=True)]
        cov = [
            (a, b, float(self.cov[i, j]))
            for i, a in enumerate(self.names)
            for j, b in enumerate(self.names)
        ]
        info = {
            "n": self.n, "ids": self.ids, "sigma2": self.sigma2, "var_id": self.var_id,
            "edf": self.edf, "resid_dev": self.rss, "null_dev": self.null_dev,
            "aic": self.aic, "reml": self.reml, "at_edge": float(self.edge is not None),
        }
        return {
            "coefficients": spark.createDataFrame(coef, "term string, estimate double, se double"),
            "covariance": spark.createDataFrame(cov, "a string, b string, value double"),
            "summary": spark.createDataFrame(
                [(k, float(v)) for k, v in info.items()], "name string, value double"
            ),
        }


def model_cells(df: DataFrame, y: str, keys: Sequence[str]) -> DataFrame:
    """Readings merged per design cell: count, mean and centred sum of squares."""
    ok = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return df.filter(ok).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(y)).alias("ss"),
    )


def _solve(s: Sums, pen: np.ndarray, unpenalised: int, block_logdet: float) -> dict:
    """β, its covariance shape and the REML criterion for one penalty."""
    h = s.xx + pen - s.cc
    u = s.xy - s.cz
    hinv = np.linalg.pinv(h, hermitian=True)
    beta = hinv @ u
    pss = max(float(s.yy - s.zz - u @ beta), 1e-300)
    df = s.n - unpenalised
    eig = np.linalg.eigvalsh(pen)
    pen_logdet = np.log(eig[eig > 1e-9 * max(eig.max(), 1e-30)]).sum() if eig.max() > 0 else 0.0
    hl = np.linalg.eigvalsh(h)
    h_logdet = np.log(hl[hl > 1e-12 * hl.max()]).sum()
    sigma2 = pss / df
    reml = (
        df * (np.log(2 * np.pi * sigma2) + 1) + s.logdet + h_logdet - pen_logdet
        - s.ids * block_logdet
    )
    return {"beta": beta, "hinv": hinv, "sigma2": sigma2, "reml": float(reml), "pss": pss}


def _smooth_grid(s: Sums, shape: np.ndarray) -> np.ndarray:
    """Smoothing penalties to try: from nearly none to a straight line at this n."""
    if not shape.any():
        return np.array([0.0])
    used = np.diag(shape) > 0
    scale = np.log10(max(np.diag(s.xx)[used].sum() / np.diag(shape).sum(), 1.0))
    return 10 ** np.arange(-3.0, scale + 6.1, 0.25)


def _logdet(m: np.ndarray | None) -> float:
    return 0.0 if m is None else float(np.linalg.slogdet(m)[1])


@dataclass
class Cells:
    """Cells laid out by individual, and what all models of them share."""

    rows: DataFrame
    keys: list[str]
    factors: dict[str, list[str]]
    between: tuple[str, ...]
    center: float
    per_id: float
    ends: tuple[float, ...]


def _cells(
    df: DataFrame, y: str, id_col: str | None, x: str | None, factors: Mapping[str, Sequence[str]], laid_out: bool
) -> Cells:
    keys = [c for c in dict.fromkeys([id_col, x, *factors]) if c]
    cells = model_cells(df, y, keys)
    cells = by_individual(cells, id_col) if laid_out else settle(cells)
    for f, levels in factors.items():
        stray = cells.filter(~F.col(f).isin(*levels)).select(f).first()
        if stray is not None:
            raise ValueError(f"{f} has the level {stray[0]!r}, which is not listed: see listed_rows")
    between = _between(cells, id_col, list(factors)) if id_col else ()
    span = [F.min(x), F.max(x)] if x is not None else []
    owners = F.approx_count_distinct(id_col) if id_col else F.lit(1)
    center, per_id, *ends = cells.agg(
        F.sum(F.col("n") * F.col("mean")) / F.sum("n"), F.sum("n") / owners, *span
    ).first()
    off = F.col("mean") - F.lit(float(center))
    rows = cells.withColumns({"sy": F.col("n") * off, "syy": F.col("ss") + F.col("n") * off * off})
    levels = {f: list(found) for f, found in factors.items()}
    return Cells(rows, keys, levels, between, float(center), float(per_id), tuple(map(float, ends)))


def smooth_cells(
    df: DataFrame, y: str, x: str, factors: Mapping[str, Sequence[str]], id: str, step: float = 1.0
) -> Cells:
    """Readings as cells for several fits of :func:`fit_smooth`, merged and laid out once.

    A fit may use some of the factors: it only sees finer cells than it needs, which
    leaves all its sums the same.
    """
    return _cells(bin_x(df, x, step), y, id, x, factors, True)


def _fit(cells: Cells, design: Design, id_col: str | None, kind: str | None, rounds: int) -> Fit:
    between = tuple(f for f in cells.between if f in design.factors) if id_col else ()
    center, per_id = cells.center, cells.per_id
    if cells.ends:
        design.lo, design.hi = cells.ends
    parts = individual_parts(cells.rows, id_col, design, kind)
    keys = [c for c in dict.fromkeys([id_col, design.x, *design.factors]) if c]
    own = cells.rows
    if keys != cells.keys:
        own = own.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
        own = own.repartition(id_col).sortWithinPartitions(id_col) if kind else own

    size = design.size
    if kind == "curve":

        def block(theta: Sequence[float]) -> np.ndarray:
            return 10 ** theta[0] * curvature(size) + 10 ** theta[1] * np.eye(size)

        # From free curves to straight lines (to none) at this many readings each.
        top = np.log10(max(float(per_id), 1.0)) + 4.0
        grid = [(a, b) for a in np.linspace(-1.0, top, 5) for b in np.linspace(-1.0, top, 5)]
        step = np.array([(top + 1.0) / 4] * 2)
    elif kind == "intercept":

        def block(theta: Sequence[float]) -> np.ndarray:
            return np.array([[10 ** theta[0]]])

        grid = [(a,) for a in np.arange(-4.0, 9.1, 1.0)]
        step = np.array([1.0])
    else:
        grid, step, rounds = [()], np.array([]), 1

        def block(theta: Sequence[float]) -> np.ndarray:
            return np.zeros((1, 1))

    shape = design.penalty()
    null_space = shape.shape[0] - int(np.linalg.matrix_rank(shape))
    best = None
    for _ in range(rounds):
        sums = block_sums(parts, [block(t) for t in grid])
        smooths = _smooth_grid(sums[0], shape)
        for theta, s in zip(grid, sums, strict=True):
            logdet = _logdet(block(theta)) if kind else 0.0
            for lam in smooths:
                got = _solve(s, lam * shape, null_space, logdet)
                if best is None or got["reml"] < best[0]["reml"]:
                    best = (got, theta, s, lam)
        # Next round: a finer grid around the best penalty so far.
        step = step / 4
        moves = np.arange(-3, 4)
        if kind == "curve":
            grid = [
                (best[1][0] + i * step[0], best[1][1] + j * step[1])
                for i in moves[::2] for j in moves[::2]
            ] + [best[1]]
        else:
            grid = [(best[1][0] + i * step[0],) for i in moves] if kind else grid
    edge = None
    if kind == "intercept":
        best, edge = _finish_ratio(best, parts, block, shape, null_space)
    if shape.any():
        best = _finish_smooth(best, shape, null_space, _logdet(block(best[1])) if kind else 0.0)
    got, theta, s, lam = best
    pen = lam * shape
    beta, hinv = got["beta"], got["hinv"]
    block_edf = 0.0
    penalties = float(beta @ pen @ beta)
    if kind:
        block_edf = s.ids * parts.k - s.tr - float(np.trace(hinv @ s.cpc))
        penalties += float(s.zpz - 2 * beta @ s.cpz + beta @ s.cpc @ beta)
    edf = len(beta) - float(np.trace(hinv @ pen)) + block_edf
    return Fit(
        design=design, names=design.names(), coef=beta, hinv=hinv, sigma2=got["sigma2"],
        n=int(s.n), ids=int(s.ids), reml=got["reml"], edf=edf, rss=got["pss"] - penalties,
        null_dev=float(s.yy), center=float(center), smooth_penalty=lam, id_col=id_col,
        kind=kind, cells=own, block_penalty=block(theta) if kind else None, block_edf=block_edf,
        edge=edge, between=between,
    )


def listed_rows(df: DataFrame, factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose factors have listed levels: the one row set that fits to be compared share."""
    for f, levels in factors.items():
        df = df.filter(F.col(f).isin(*levels))
    return df


def _between(cells: DataFrame, id_col: str, factors: list[str]) -> tuple[str, ...]:
    """Factors that don't vary inside an individual."""
    if not factors:
        return ()
    same = [(F.min(f).eqNullSafe(F.max(f))).alias(f"_b_{f}") for f in factors]
    row = cells.groupBy(id_col).agg(*same).agg(*[F.min(f"_b_{f}") for f in factors]).first()
    return tuple(f for f, one in zip(factors, row, strict=True) if one)


#: Log10 of the ratio beyond which the criterion has only fallen towards no variance at all.
NO_VARIANCE = 8.9


def _finish_ratio(best, parts: Parts, block, shape, null_space):
    """The optimum of the variance ratio from a parabola through the last grid's neighbours."""
    _, (at,), _, lam = best
    if at >= NO_VARIANCE:
        return best, "none"
    if at <= -4.0:
        return best, "only"

    def at_points(points):
        sums = block_sums(parts, [block((p,)) for p in points])
        return [
            (_solve(s, lam * shape, null_space, _logdet(block((p,)))), (p,), s, lam)
            for p, s in zip(points, sums, strict=True)
        ]

    for width in (1 / 64, 1 / 512):
        found = at_points([at - width, at, at + width])
        low, mid, high = (f[0]["reml"] for f in found)
        bend = low - 2 * mid + high
        move = 0.5 * width * (low - high) / bend if bend > 0 else 0.0
        at += float(np.clip(move, -width, width))
    return at_points([at])[0], None


def _finish_smooth(best, shape, null_space, logdet):
    """The smoothing penalty between the points of its grid, on the sums already collected."""
    got, theta, s, lam = best
    at = np.log10(lam)
    for width in (0.25, 0.05, 0.01):
        points = at + width * np.linspace(-1, 1, 11)
        tried = [_solve(s, 10**p * shape, null_space, logdet) for p in points]
        k = int(np.argmin([t["reml"] for t in tried]))
        if tried[k]["reml"] <= got["reml"]:
            got, at = tried[k], points[k]
    return got, theta, s, float(10**at)


def fit_random_intercept(
    df: DataFrame,
    y: str,
    factors: Mapping[str, Sequence[str]],
    id: str = "id",
    interactions: Sequence[tuple[str, ...]] = (),
    rounds: int = 4,
) -> Fit:
    """``y ~ factors + interactions + (1 | id)`` by REML.

    Levels are listed by the caller, first level as reference. The variance
    ratio is searched on a grid that is refined ``rounds`` times; each round is
    one Spark job over the cells, and individuals are never collected.
    """
    design = Design({k: list(v) for k, v in factors.items()}, [tuple(i) for i in interactions])
    return _fit(_cells(df, y, id, None, design.factors, True), design, id, "intercept", rounds)


def fit_smooth(
    df: DataFrame | Cells,
    y: str,
    x: str,
    factors: Mapping[str, Sequence[str]] | None = None,
    interactions: Sequence[tuple[str, ...]] = (),
    by: str | None = None,
    id: str | None = None,
    id_curves: bool = False,
    size: int = 10,
    step: float = 1.0,
    rounds: int = 3,
) -> Fit:
    """Additive model ``y ~ s(x) + factors`` with optional individual terms.

    ``by`` fits one curve per level of a factor. ``id`` adds a random
    intercept; ``id_curves`` a penalised curve of deviation per individual
    instead. x is binned to ``step`` first, which bounds the cells of any one
    individual. Smoothness and variance ratios are chosen by REML. Several fits
    of the same rows can share :func:`smooth_cells` in place of ``df``.
    """
    design = Design(
        {k: list(v) for k, v in (factors or {}).items()},
        [tuple(i) for i in interactions], x=x, by=by, size=size,
    )
    kind = None if id is None else ("curve" if id_curves else "intercept")
    if isinstance(df, Cells):
        cells = df
        if {f: cells.factors.get(f) for f in design.factors} != design.factors:
            raise ValueError("the cells were made for other factors or levels")
    else:
        cells = _cells(bin_x(df, x, step), y, id, x, design.factors, kind is not None)
    return _fit(cells, design, id, kind, rounds)


def bin_x(df: DataFrame, x: str, step: float = 1.0) -> DataFrame:
    """Round the covariate to a multiple of ``step`` (ties to even)."""
    return df.withColumn(x, F.rint(F.col(x) / F.lit(float(step))) * F.lit(float(step)) + F.lit(0.0))


# ---- predictions -----------------------------------------------------------


def predict_fit(fit: Fit, new: DataFrame | None = None) -> DataFrame:
    """Fitted value and standard error per data cell (or per row of ``new``).

    An individual's own term comes from the cells the model was fitted to.
    ``new`` holds rows (id, x, factors) to predict.
    """
    d = fit.design
    keys = [c for c in dict.fromkeys([fit.id_col, d.x, *d.factors]) if c]
    if fit.kind is None:
        rows = fit.cells if new is None else new
        return predict_fixed(rows.select(*keys), d.columns(), fit.beta, fit.cov, keys)
    cells = fit.cells.select(*keys, "n", "sy", F.lit(new is None).alias("_show"))
    if new is not None:
        asked = new.select(
            *keys, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sy"), F.lit(True).alias("_show")
        )
        cells = cells.unionByName(asked).repartition(fit.id_col).sortWithinPartitions(fit.id_col)
    out = predict_cells(
        cells, fit.id_col, d, fit.kind, fit.block_penalty, fit.coef, fit.hinv,
        fit.sigma2, [*keys, "_show"], fit.center,
    )
    return out.filter("_show").drop("_show")


def predict_grid_mean(
    predicted: DataFrame,
    keys: Sequence[str] = ("temp", "sex"),
    x: str = "temp",
    fit: str = "fit",
    round_x: str = "after",
    clamp: bool = False,
) -> DataFrame:
    """Grid predictions averaged over individuals.

    ``round_x="after"`` rounds the grid temperature to whole degrees after
    predicting, ``"never"`` keeps it; to round before predicting, pass the grid
    through :func:`bin_x`. ``clamp`` raises negative means to 0.
    """
    rows = predicted.withColumn(x, F.rint(x) + F.lit(0.0)) if round_x == "after" else predicted
    mean = F.avg(fit)
    if clamp:
        mean = F.greatest(mean, F.lit(0.0))
    return rows.groupBy(*keys).agg(mean.alias("predicted"))


def smooth_curve(
    spark: SparkSession, fit: Fit, over: Sequence[str], steps: int = 100
) -> DataFrame:
    """Population curve with a 95 % band per combination of factors.

    Factors not in ``over`` are held at their first level.
    """
    d = fit.design
    xs = np.linspace(d.lo, d.hi, steps)
    out = []
    for combo in d.grid(list(over)):
        levels = {f: lv[0] for f, lv in d.factors.items()} | combo
        m = d.matrix([levels] * steps, xs)
        mean = m @ fit.beta
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, fit.cov, m), 0))
        out += [
            (*combo.values(), float(a), float(b), float(s), float(b - Z95 * s), float(b + Z95 * s))
            for a, b, s in zip(xs, mean, se, strict=True)
        ]
    names = ", ".join(f"`{f}` string" for f in over)
    schema = f"{names}{', ' if names else ''}x double, fit double, se double, lower double, upper double"
    return spark.createDataFrame(out, schema)


# ---- summary tables --------------------------------------------------------


def _contrasts(fit: Fit, term: Sequence[str]) -> np.ndarray:
    """Hypothesis rows of a term: differences of equally weighted cell means."""
    d = fit.design
    if len(term) > 1:
        at = [i for i, (_, t, _) in enumerate(d._factor_columns()) if t == tuple(term)]
        return np.eye(len(fit.names))[at]
    means = _mean_rows(fit, term)
    return means[1:] - means[0]


def _mean_rows(fit: Fit, over: Sequence[str]) -> np.ndarray:
    d = fit.design
    others = [f for f in d.factors if f not in over]
    rows = []
    for combo in d.grid(list(over)):
        rows.append(np.mean([d.row(combo | rest) for rest in d.grid(others)], axis=0))
    out = np.array(rows)
    if d.x is not None:
        middle = d.matrix([{}], np.array([(d.lo + d.hi) / 2]))[0]
        n_factor = len(d._factor_columns())
        out[:, n_factor:] = middle[n_factor:]
    return out


def _own_rank(fit: Fit) -> int:
    """Rank of what is estimated between individuals, the mean included."""
    inside = set(fit.between)
    terms = [t for t in fit.design.terms() if inside and set(t) <= inside]
    return 1 + sum(int(np.linalg.matrix_rank(_contrasts(fit, t))) for t in terms)


def _containment_df(fit: Fit, term: Sequence[str]) -> float:
    """Denominator degrees of freedom of a term: individuals, or the readings inside them.

    Means themselves (an empty term) vary with the individuals as well.
    """
    if fit.kind is None:
        return float(fit.n - len(fit.names))
    own = _own_rank(fit)
    if set(term) <= set(fit.between):
        return float(fit.ids - own)
    return float(fit.n - fit.ids - (len(fit.names) - own))


def anova_mixed(spark: SparkSession, fit: Fit) -> DataFrame:
    """Wald F per term; denominator degrees of freedom by containment.

    A term whose factors don't vary inside an individual is tested against the
    individuals, other terms against the readings inside them.
    """
    out = []
    for term in fit.design.terms():
        rows = _contrasts(fit, term)
        est, cov = rows @ fit.coef, rows @ fit.cov @ rows.T
        df1 = int(np.linalg.matrix_rank(cov))
        f = float(est @ np.linalg.pinv(cov) @ est) / max(df1, 1)
        df2 = _containment_df(fit, term)
        out.append((":".join(term), df1, df2, f, float(f_sf(f, df1, df2))))
    return spark.createDataFrame(out, "effect string, df1 int, df2 double, f double, p double")


def marginal_means(
    spark: SparkSession, fit: Fit, over: Sequence[str], level: float = 0.95
) -> DataFrame:
    """Cell means with SE and limits, other factors weighted equally; df by containment."""
    rows = _mean_rows(fit, over)
    est = rows @ fit.beta
    se = np.sqrt(np.einsum("ij,jk,ik->i", rows, fit.cov, rows))
    df = _containment_df(fit, ())
    far = _t_ppf((1 + level) / 2, df) if df >= 1 else float("nan")
    out = [
        (*combo.values(), float(m), float(s), df, float(m - far * s), float(m + far * s))
        for combo, m, s in zip(fit.design.grid(list(over)), est, se, strict=True)
    ]
    names = ", ".join(f"`{f}` string" for f in over)
    return spark.createDataFrame(
        out, f"{names}, emmean double, se double, df double, lower_cl double, upper_cl double"
    )


def pairwise_contrasts(
    spark: SparkSession, fit: Fit, over: str, within: str | None = None
) -> DataFrame:
    """All pairs of marginal means, Tukey-adjusted, overall or within a factor; df by containment.

    Levels that don't vary inside an individual are compared against the individuals.
    """
    d = fit.design
    rows = _mean_rows(fit, [within, over] if within else [over])
    cells = d.grid([within, over] if within else [over])
    df = _containment_df(fit, [over])
    out = []
    for group in d.factors[within] if within else [None]:
        at = [i for i, c in enumerate(cells) if within is None or c[within] == group]
        for i, j in combinations(at, 2):
            diff = rows[i] - rows[j]
            est, se = float(diff @ fit.coef), float(np.sqrt(diff @ fit.cov @ diff))
            t = est / se if se > 0 else float("nan")
            p = range_sf(abs(t) * np.sqrt(2), len(at), df) if df >= 1 else float("nan")
            out.append((group, f"{cells[i][over]} - {cells[j][over]}", est, se, df, t, p))
    schema = "within string, contrast string, estimate double, se double, df double, z double, p double"
    return spark.createDataFrame(out, schema)


def smooth_terms(spark: SparkSession, fit: Fit) -> DataFrame:
    """Per-term table: parametric Wald tests, effective df and rank-limited tests of the smooths."""
    cov, d = fit.cov, fit.design
    n_factor = len(d._factor_columns())
    df2 = max(fit.n - fit.edf, 1.0)
    out = []
    for i in range(n_factor):
        se = float(np.sqrt(cov[i, i]))
        t = float(fit.beta[i]) / se
        out.append((fit.names[i], "parametric", 1.0, float(fit.beta[i]), se, t, float(t_two_sided(t, df2))))
    penalty = fit.smooth_penalty * d.penalty()
    used = np.eye(len(fit.coef)) - fit.hinv @ penalty
    gram = np.linalg.inv(fit.hinv) - penalty
    # The rank of a test lets directions count that are shrunk by half twice over.
    once, twice = np.diag(used), np.diag(2 * used - used @ used)
    for tag, at in d.spline_blocks().items():
        block = np.ix_(at, at)
        wald, p = smooth_wald(fit.coef[at], cov[block], gram[block], float(twice[at].sum()))
        out.append((tag, "smooth", float(once[at].sum()), None, None, wald, p))
    if fit.kind:
        label = f"s(id, {fit.kind})"
        out.append((label, "random", float(fit.block_edf), None, None, None, None))
    dev = float(100 * (1 - fit.rss / fit.null_dev))
    out.append(("deviance explained %", "model", float(fit.edf), dev, None, None, None))
    return spark.createDataFrame(
        out, "term string, part string, edf double, estimate double, se double, statistic double, p double"
    )


def fits_table(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Fits as rows for :func:`ectolog.stats.compare.model_compare`; all of the same readings."""
    sizes = {m: f.n for m, f in fits.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"models of different readings can't be compared: {sizes}")
    rows = [
        (m, float(f.n - f.edf), float(f.rss), float(f.aic), float(f.null_dev))
        for m, f in fits.items()
    ]
    return spark.createDataFrame(
        rows, "model string, resid_df double, resid_dev double, aic double, null_dev double"
    )
