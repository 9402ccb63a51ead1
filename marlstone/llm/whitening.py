"""Whitening of embeddings by an incremental eigendecomposition.

An entry c counts as the whole number ``x = floor(64 * c) + 1000000``.  The fit list holds
every distinct x-vector once.  Each task goes through its part of the list and keeps the
spectrum of what it has seen: count, mean, and the eigenpairs of the centred scatter matrix.
A row is one centred rank-one update, whose new eigenvalues are the roots of the secular
equation ``1 + sum(z_i^2 / (d_i - t)) = 0``; entries of ``z`` that vanish and eigenvalues that
coincide are deflated first.  Two spectra combine by one rank-one update for each eigenpair of
the smaller and one for the distance of their means, in a reduction tree of written tables.

The basis that is left is refined by one Rayleigh-Ritz step over the whole list, with exact
sums for the mean, so that its pairs are right to double precision.  A last pass measures the
covariance of the whitened list.

A task holds one batch and a spectrum of ``width^2`` numbers, the driver one spectrum for
each width.

Rows whose vector is null or has null or non-finite entries are dropped, those without entries
too; rows with a null key stay.  Vectors of different widths are different spaces: each is
fitted for itself.  Directions without variance (relative to the largest: under 1e-12) have no
whitened value and no rows; a list of one vector gives no rows at all.  Entries beyond
+-2^53 / 64 count as that.  Deviations beyond a long are its largest value.  Where eigenvalues
are equal their directions are one of the many right choices, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 16
SCALE, ORIGIN = 64, 1_000_000
FILE_ROWS, FAN_IN, REFRESH = 8_192, 16, 4_096
_LARGEST, _EPS, _FLAT = float(1 << 53), np.finfo(float).eps, 1e-12
_BELOW = np.tri(512)


def _deflated(d: np.ndarray, z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Places that take part in the secular equation; turns ``z`` and ``turn`` so that equal values have one of them."""
    least = 8 * _EPS * max(d[-1], z @ z)
    live = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > least)
    if live.size > 1 and (np.diff(d[live]) <= least).any():
        kept = [live[0]]
        for i in live[1:]:
            p = kept[-1]
            if d[i] - d[p] <= least:
                size = np.hypot(z[p], z[i])
                c, s = z[i] / size, z[p] / size
                z[p], z[i] = 0.0, size
                turn[:, [p, i]] = turn[:, [p, i]] @ np.array([[c, s], [-s, c]])
                kept[-1] = i
            else:
                kept.append(i)
        live = np.array(kept)
    return live


def _roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``d_j - root_i`` for the roots of the secular equation of ascending ``d`` with weights ``w``, row by row.

    Every root is sought from the nearer end of its interval, so that small differences keep
    their digits: rational steps, halving where one leaves the bracket.
    """
    k = d.size
    last, total = k - 1, w.sum()
    gap = np.append(np.diff(d), total)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (w / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    left = (middle >= 0) | (np.arange(k) == last)
    at = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, last))
    away = d[None, :] - d[at][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[last] = total
    mu, open_ = (low + high) / 2, np.arange(k)  # the roots still sought
    for _ in range(80):
        i, after = open_, np.minimum(open_ + 1, last)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = away[i] - mu[i, None]
            terms = w / t
            slopes = terms / t
            below = _BELOW[i, :k] if k <= len(_BELOW) else np.tri(k)[i]
            psi, slope = np.einsum("ij,ij->i", terms, below), np.einsum("ij,ij->i", slopes, below)
            phi, rise = terms.sum(1) - psi, slopes.sum(1) - slope
            f = 1 + psi + phi
            at_root = np.abs(f) <= 4 * _EPS * k * (1 + np.abs(psi) + np.abs(phi))
            low[i], high[i] = np.where(f < 0, mu[i], low[i]), np.where(f > 0, mu[i], high[i])
            rows = np.arange(i.size)
            one, two = t[rows, i], t[rows, after]
            a, b, c = (one + two) * f - one * two * (slope + rise), one * two * f, f - one * slope - two * rise
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(i == last, one + one**2 * slope / (1 + psi - one * slope), step)
            new = mu[i] + step
            new = np.where(np.isfinite(new) & (new > low[i]) & (new < high[i]), new, (low[i] + high[i]) / 2)
        goes = ~at_root & (new != mu[i])
        mu[i] = np.where(goes, new, mu[i])
        open_ = i[goes]
        if not open_.size:
            break
    return away - mu[:, None]


def rank_one(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors (columns) of ``diag(d) + z z^T`` for ascending ``d >= 0``."""
    d, z, turn = d.copy(), z.copy(), np.eye(d.size)
    live = _deflated(d, z, turn)
    if not live.size:
        return d, turn
    far = _roots(d[live], z[live] ** 2)  # far[i, j] = d_j - root_i
    poles = d[live]
    values = d.copy()
    values[live] = poles - np.diagonal(far)
    # weights for which the roots found are exact, so that the vectors are orthogonal
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = far / between  # root i against pole j, without the pole itself
    np.fill_diagonal(ratio, np.diagonal(far))
    weights = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[live])
    with np.errstate(divide="ignore", invalid="ignore"):
        vectors = weights[:, None] / far.T
    odd = ~np.isfinite(vectors).all(axis=0)
    vectors[:, odd] = np.eye(live.size)[:, odd]  # a root on its pole: nothing has turned
    vectors /= np.linalg.norm(vectors, axis=0)
    turn[:, live] = turn[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], turn[:, order]


class Spectrum:
    """Count, mean and eigenpairs of the centred scatter matrix of some points, kept up row by row."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors, self._since = np.zeros(0), np.zeros((width, 0)), 0

    def add(self, x: np.ndarray) -> None:
        """One more point."""
        gap, share = x - self.mean, self.n / (self.n + 1)
        self.n += 1
        self.mean = self.mean + gap / self.n
        if share:
            self.update(gap * np.sqrt(share))

    def combine(self, other: Spectrum) -> None:
        """All the points of another spectrum."""
        if not other.n:
            return
        gap, both = other.mean - self.mean, self.n + other.n
        between = gap * np.sqrt(self.n * other.n / both)
        self.mean, self.n = self.mean + gap * (other.n / both), both
        self.update(between)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector * np.sqrt(value))

    def update(self, v: np.ndarray) -> None:
        """Add ``v v^T`` to the scatter matrix."""
        size = np.linalg.norm(v)
        if not size > 0:
            return
        z = self.vectors.T @ v
        rest = v - self.vectors @ z
        more = self.vectors.T @ rest
        z, rest = z + more, rest - self.vectors @ more
        new = np.linalg.norm(rest)
        values, vectors = self.values, self.vectors
        if new > 1e-13 * size and values.size < v.size:  # a direction not seen before
            values, vectors, z = np.concatenate([[0.0], values]), np.column_stack([rest / new, vectors]), np.concatenate([[new], z])
        self.values, turn = rank_one(values, z)
        self.vectors = vectors @ turn
        self._since += 1
        if self._since >= REFRESH:
            self.refresh()

    def refresh(self) -> None:
        """Make the vectors orthogonal again, as roundings add up."""
        self._since = 0
        q, r = np.linalg.qr(self.vectors)
        values, turn = np.linalg.eigh((r * self.values) @ r.T)
        self.values, self.vectors = np.maximum(values, 0.0), q @ turn


def _parts(n: int, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: whole numbers of 64 bits where they hold it, else of any size."""
    largest = max(map(abs, [*sums.tolist(), 0])) + n * int(np.abs(x).max(initial=0))
    if largest < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _centred(n: int, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (_parts(n, sums, x) / n).astype(float)


def _by_width(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of equally wide x-vectors."""
    for batch in batches:
        widths = batch["x"].map(len)
        for width, rows in batch["x"].groupby(widths):
            yield int(width), np.stack(rows.to_numpy())


def _spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spectrum and exact sums of a task's part of the fit list, one for each width."""
    found: dict[int, tuple[Spectrum, np.ndarray]] = {}
    for width, x in _by_width(batches):
        spectrum, sums = found.setdefault(width, (Spectrum(width), np.zeros(width, object)))
        for row in (x - ORIGIN).astype(float):
            spectrum.add(row)
        sums += x.sum(0, dtype=object)
    yield pd.DataFrame([_row(width, *held) for width, held in found.items()], columns=["width", "n", "sums", "mean", "eigenvalues", "vectors"])


def _row(width: int, s: Spectrum, sums: np.ndarray) -> tuple:
    return width, s.n, [Decimal(int(v)) for v in sums], s.mean, s.values, s.vectors.ravel()


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    width = int(rows["width"].iloc[0])
    rows = rows.sort_values(["n", "place"], ascending=[False, True])
    whole, sums = Spectrum(width), np.zeros(width, object)
    for r in rows.itertuples():
        part = Spectrum(width)
        part.n, part.mean, part.values = int(r.n), np.array(r.mean, float), np.array(r.eigenvalues, float)
        part.vectors = np.array(r.vectors, float).reshape(width, part.values.size)
        whole.combine(part)
        sums += np.array([int(v) for v in r.sums], object)
    return pd.DataFrame([_row(width, whole, sums)], columns=["width", "n", "sums", "mean", "eigenvalues", "vectors"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"width": rows["width"].iloc[:1], "total": [np.sum(np.stack(rows["total"].to_numpy()), axis=0)]})


def _reduced(rows: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], scratch, name: str) -> DataFrame:
    """One row for each width, ``FAN_IN`` rows combined in a task at a time."""
    schema = rows.schema
    rows, step = scratch.keep(rows.withColumn("place", F.monotonically_increasing_id()), f"{name}-0"), 0
    while True:
        most = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rows.drop("place")
        groups = -(-most // FAN_IN)
        merged = rows.withColumn("_group", F.pmod(F.xxhash64("place"), F.lit(groups))).groupBy("width", "_group").applyInPandas(merge, schema)
        step += 1
        rows = scratch.keep(merged.withColumn("place", F.monotonically_increasing_id()), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")


class Whitening:
    """Per width: ``n``, exact ``sums``, directions (columns), their eigenvalues, shares of the trace, and the error measured."""

    def __init__(self, spaces: dict[int, dict]):
        self.spaces = spaces

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Add ``n, deviation, component, whitened, explained, identity_error`` to rows of x-vectors, a row for each component."""
        shared = df.sparkSession.sparkContext.broadcast(self.spaces)
        kept = [c for c in df.columns if c != x]

        @F.pandas_udf("n long, deviation long, identity_error double, of array<struct<whitened:double,explained:double>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list = [None] * len(batch)
                for width, at in pd.Series(range(len(batch))).groupby(batch.map(len).to_numpy()):
                    space, rows = shared.value[int(width)], np.stack(batch.iloc[at].to_numpy())
                    parts = _parts(space["n"], space["sums"], rows)
                    if parts.dtype == object or width * float(np.abs(parts).max()) ** 2 > 1 << 62:
                        parts = parts.astype(object)
                    square = np.minimum((parts * parts).sum(1), (1 << 63) - 1).astype(np.int64)
                    whitened = (parts / space["n"]).astype(float) @ space["vectors"] / np.sqrt(space["values"])
                    for i, s, w in zip(at, square.tolist(), whitened.tolist(), strict=True):
                        out[i] = (space["n"], s, space["error"], list(zip(w, space["explained"], strict=True)))
                yield pd.DataFrame(out, columns=["n", "deviation", "identity_error", "of"])

        found = df.select(F.struct(*kept).alias("_row"), run(F.col(x)).alias("_found"))
        each = found.select("_row", "_found", F.posexplode("_found.of").alias("_place", "_value"))
        return each.select(
            *[F.col("_row")[c].alias(c) for c in kept], (F.col("_place") + 1).alias("component"), "_found.n", "_found.deviation", "_value.whitened", "_value.explained", "_found.identity_error"
        )


def whole_numbers(vector: str):
    """The x-vector of a column of vectors; null for a null or empty one, and for null or non-finite entries."""
    clean = F.col(vector).cast("array<double>")
    odd = F.exists(clean, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clip = lambda c: F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(-_LARGEST)), F.lit(_LARGEST))
    return F.when((F.size(clean) > 0) & ~odd, F.transform(clean, lambda c: F.floor(clip(c)).cast("long") + F.lit(ORIGIN)))


def _refined(fit: DataFrame, basis: dict[int, dict], components: int, scratch) -> dict[int, dict]:
    """Rayleigh-Ritz over the whole list in the spaces that the bases span, and the covariance of the whitened list."""
    context = fit.sparkSession.sparkContext
    bases = context.broadcast(basis)

    def products(spaces, project):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[int, np.ndarray] = {}
            for width, x in _by_width(batches):
                y = project(spaces.value[width], x)
                y = np.column_stack([np.ones(len(y)), y])  # the first row of the products holds the sums
                totals[width] = totals.get(width, 0) + y.T @ y
            yield pd.DataFrame([(w, t.ravel()) for w, t in totals.items()], columns=["width", "total"])

        return run

    def gathered(spaces, project, name):
        rows = _reduced(fit.mapInPandas(products(spaces, project), "width int, total array<double>"), _summed, scratch, name).collect()  # one row for each width
        return {r["width"]: np.array(r["total"]).reshape(int(np.sqrt(len(r["total"]))), -1) for r in rows}

    spaces = {}
    for width, total in gathered(bases, lambda s, x: _centred(s["n"], s["sums"], x) @ s["vectors"], "ritz").items():
        space = basis[width]
        values, turn = np.linalg.eigh(total[1:, 1:] / space["n"])
        values, turn = values[::-1], turn[:, ::-1]
        good = int((values[:components] > _FLAT * max(values[0], 0.0)).sum()) if values.size and values[0] > 0 else 0
        vectors = space["vectors"] @ turn[:, :good]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(good)])
        spaces[width] = {"n": space["n"], "sums": space["sums"], "vectors": vectors, "values": values[:good], "explained": (values[:good] / max(values.sum(), 1e-300)).tolist(), "error": 0.0}
    found = context.broadcast(spaces)
    for width, total in gathered(found, lambda s, x: _centred(s["n"], s["sums"], x) @ s["vectors"] / np.sqrt(s["values"]), "white").items():
        n = total[0, 0]
        covariance = total[1:, 1:] / n - np.outer(total[0, 1:] / n, total[0, 1:] / n)
        spaces[width]["error"] = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return spaces


def fit_whitening(rows: DataFrame, scratch, x: str = "x", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x-vectors of ``rows``, with at most so many components."""
    distinct = rows.select(F.col(x).alias("x")).where("x is not null").distinct()
    path = f"{scratch.root}/fit"
    distinct.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)  # small files: a row costs far more than reading it
    fit = scratch.spark.read.schema(distinct.schema).parquet(path)
    partial = fit.mapInPandas(_spectra, "width int, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, vectors array<double>")
    basis = {}
    for r in _reduced(partial, _combined, scratch, "spectra").collect():  # one row for each width
        vectors = np.array(r["vectors"]).reshape(r["width"], -1)
        basis[r["width"]] = {"n": r["n"], "sums": np.array([int(v) for v in r["sums"]], object), "vectors": np.linalg.qr(vectors)[0]}
    return Whitening(_refined(fit, basis, components, scratch))


def whiten(df: DataFrame, scratch, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row with a whole vector."""
    rows = df.select(F.col(key).alias("_key"), whole_numbers(vector).alias("x")).where("x is not null")
    white = fit_whitening(rows, scratch, components=components).apply(rows)
    return white.select(F.col("_key").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error")
