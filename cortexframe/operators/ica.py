"""Independent component analysis.

Moments are gathered on the cluster (one small matrix a partition), the small
eigenproblems and rotations are solved on the driver, and maps to sources and back
are sums over channels.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ICA:
    """Settings and, once fitted, matrices; channels in order of the columns."""

    channels: list[str] = field(default_factory=list)
    pre_whitener: np.ndarray | None = None  # a number a channel
    mean: np.ndarray | None = None
    components: np.ndarray | None = None  # rows are principal directions
    variance: np.ndarray | None = None
    unmixing: np.ndarray | None = None
    exclude: tuple[int, ...] = ()
    n_iter: int = 0

    @property
    def n_components(self) -> int:
        return 0 if self.unmixing is None else len(self.unmixing)

    def to_sources(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights (component x channel) and offsets of the map from samples to sources."""
        p = self.components[: self.n_components] / np.sqrt(self.variance[: self.n_components])[:, None]
        w = self.unmixing @ p
        return w / self.pre_whitener, -w @ self.mean

    def from_sources(self) -> np.ndarray:
        """Weights (channel x component) of the map back, without the mean."""
        k = self.n_components
        return self.pre_whitener[:, None] * (self.components[:k].T * np.sqrt(self.variance[:k])) @ np.linalg.inv(self.unmixing)

    def cleaning(self, exclude: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights (channel x channel) and offsets that take a sample to the sample without excluded sources."""
        exclude = self.exclude if exclude is None else exclude
        w, offset = self.to_sources()
        keep = np.ones(self.n_components)
        keep[[i - 1 for i in exclude]] = 0
        back = self.from_sources() * keep
        return back @ w, back @ offset + self.pre_whitener * self.mean

    def topography(self, k: int) -> np.ndarray:
        """Weights of component ``k`` (from 1) on channels."""
        if not 1 <= k <= self.n_components:
            raise ValueError(f"there is no component {k}")
        return self.from_sources()[:, k - 1]


def set_exclude(ica: ICA, components: list[int] | None) -> ICA:
    """Replace the excluded components, sorted and once each; None clears."""
    chosen = tuple(sorted(set(components or ())))
    if any(not 1 <= c <= ica.n_components for c in chosen):
        raise ValueError("no such component")
    return replace(ica, exclude=chosen)


def pre_whitener(signal: DataFrame, channels: DataFrame) -> DataFrame:
    """``recording_id, channel_type, sd``: population deviation pooled over channels of a type."""
    typed = signal.join(channels.select("recording_id", "ch_idx", "channel_type"), ["recording_id", "ch_idx"])
    return typed.groupBy("recording_id", "channel_type").agg(F.stddev_pop("value").alias("sd"))


#: samples whose channels meet in one matrix
COV_BLOCK = 4_096


def covariance(signal: DataFrame, block: int = COV_BLOCK) -> DataFrame:
    """``recording_id, ch_a, ch_b, cov`` of all channel pairs (a <= b) over the samples that have both.

    Blocks of samples are gathered once as matrices; each gives the pairs' counts, sums and
    centred products, and only these, channels squared a block, are added up.
    """
    values = signal.where("value is not null").groupBy("recording_id", F.floor(F.col("sample_idx") / F.lit(block)).alias("_block"))
    gathered = values.agg(F.collect_list(F.struct(F.col("ch_idx").cast("int").alias("c"), F.col("sample_idx").cast("long").alias("i"), F.col("value").cast("double").alias("v"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            cuts, flat = lists.offsets.to_numpy(), lists.values
            every = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            ids, out = [], []
            for row, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                c, i, v = (x[low:high] for x in every)
                chans, at_c = np.unique(c, return_inverse=True)
                samples, at_i = np.unique(i, return_inverse=True)
                m, have = np.zeros((len(chans), len(samples))), np.zeros((len(chans), len(samples)))
                m[at_c, at_i], have[at_c, at_i] = v, 1.0
                middle = m.sum(1, keepdims=True) / have.sum(1, keepdims=True)
                m = (m - middle) * have  # near 0, so that products don't cancel
                n, own, both = have @ have.T, m @ have.T, m @ m.T
                a, b = np.triu_indices(len(chans))
                k = n[a, b] > 0
                a, b = a[k], b[k]
                ids.append(np.full(len(a), row))
                count, of_a, of_b = n[a, b], own[a, b], own[b, a]
                out.append((chans[a], chans[b], count, of_a + count * middle[a, 0], of_b + count * middle[b, 0], both[a, b] - of_a * of_b / count))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), *[pa.array(x) for x in cols]], names=["recording_id", "ch_a", "ch_b", "n", "a", "b", "ab"])

    parts = gathered.select("recording_id", "x").mapInArrow(run, f"recording_id {signal.schema['recording_id'].dataType.simpleString()}, ch_a int, ch_b int, n double, a double, b double, ab double")
    # deviations from the means over all blocks, which share the grouping's exchange; sums of large products would cancel
    pair = Window.partitionBy("recording_id", "ch_a", "ch_b")
    off = lambda c: F.col(c) / F.col("n") - F.sum(c).over(pair) / F.sum("n").over(pair)
    centred = parts.withColumn("product", F.col("ab") + F.col("n") * off("a") * off("b"))
    return centred.groupBy("recording_id", "ch_a", "ch_b").agg(F.when(F.sum("n") > 1, F.sum("product") / (F.sum("n") - 1)).alias("cov"))


def sample_vectors(signal: DataFrame, channels: list[str]) -> DataFrame:
    """``sample_idx, x``: one array a sample, in the order of ``channels``; samples that lack one are left out."""
    place = F.create_map(*[F.lit(v) for i, c in enumerate(channels) for v in (c, i)])
    rows = signal.where(F.col("channel").isin(channels)).groupBy("recording_id", "sample_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(place[F.col("channel")].alias("i"), F.col("value").alias("v")))), lambda s: s["v"]).alias("x")
    )
    return rows.where(F.size("x") == len(channels))


def _sums(vectors: DataFrame, make, size: int) -> np.ndarray:
    """Sum over partitions of a flat array that ``make`` computes from a matrix of samples; one row a partition reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += make(np.stack(batch["x"].to_list()))
        yield pd.DataFrame({"s": [total]})

    parts = vectors.select("x").mapInPandas(run, "s array<double>")
    spread = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in spread.collect():  # as many rows as the matrix has entries
        out[r["i"]] = r["v"]
    return out


def fit_ica(
    signal: DataFrame, channels: list[str], types: list[str] | None = None, n_components: int | float | None = None, fun: str = "logcosh", alpha: float = 1.0,
    max_iter: int = 1000, tol: float = 1e-4, w_init: np.ndarray | None = None, seed: int = 0, algorithm: str = "parallel", method: str = "fastica", noise_cov: np.ndarray | None = None,
) -> ICA:
    """Fit by pooled scaling, principal components, and a fixed point, each a pass over samples.

    ``algorithm``: "parallel" turns all directions at once and makes them orthonormal together;
    "deflation" finds one after the other, each kept orthogonal to those before.  Whitening by
    ``noise_cov`` and other methods than "fastica" are not supported and are an error.

    ``types`` pools the scaling by kind of channel.  ``n_components``: None keeps the share
    0.999999 of the variance, a float that share, an int that many.
    """
    if len(channels) < 2:
        raise ValueError("at least two channels are needed")
    if algorithm not in ("parallel", "deflation") or fun not in ("logcosh", "exp", "cube") or tol < 0 or max_iter < 1:
        raise ValueError("unknown algorithm or contrast function, or a bound out of range")
    if method != "fastica" or noise_cov is not None:
        raise NotImplementedError("only fastica with pooled scaling is supported")
    d = len(channels)
    vectors = sample_vectors(signal, channels).persist()
    try:
        m = _sums(vectors, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), 1 + d + d * d)
        n, total, gram = m[0], m[1 : d + 1], m[d + 1 :].reshape(d, d)
        kinds = np.array(types or ["eeg"] * d)
        scale = np.empty(d)
        for kind in set(kinds.tolist()):
            own = kinds == kind
            mean = total[own].sum() / (n * own.sum())
            scale[own] = np.sqrt(max(0.0, np.diag(gram)[own].sum() / (n * own.sum()) - mean**2))
        if (scale == 0).any():
            raise ValueError("a kind of channel does not vary")
        mean = total / n / scale
        cov = (gram / np.outer(scale, scale) - n * np.outer(mean, mean)) / (n - 1)
        values, vectors_ = np.linalg.eigh(cov)
        values, rows = np.maximum(values[::-1], 0), vectors_[:, ::-1].T
        rows = rows * np.sign(rows[np.arange(d), np.abs(rows).argmax(1)])[:, None]
        k = resolve_components(n_components, values)
        z_map = rows[:k] / np.sqrt(values[:k])[:, None] / scale
        z_off = rows[:k] / np.sqrt(values[:k])[:, None] @ mean

        def moments(w: np.ndarray):
            def make(x: np.ndarray) -> np.ndarray:
                z = x @ z_map.T - z_off
                g, slope = contrast(z @ w.T, fun, alpha)
                return np.concatenate([(g.T @ z).ravel(), slope.sum(0)])

            rows = len(w)
            s = _sums(vectors, make, rows * k + rows)
            return s[: rows * k].reshape(rows, k) / n, s[rows * k :] / n

        begin = np.random.default_rng(seed).normal(size=(k, k)) if w_init is None else np.asarray(w_init, float)
        w, done = (turn_together if algorithm == "parallel" else turn_in_sequence)(moments, begin, max_iter, tol)
    finally:
        vectors.unpersist()
    return ICA(channels, scale, mean, rows, values, w, (), done)


def contrast(y: np.ndarray, fun: str, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The contrast function's first derivative and that one's slope."""
    if fun == "logcosh":
        g = np.tanh(alpha * y)
        return g, alpha * (1 - g**2)
    if fun == "exp":
        e = np.exp(-(y**2) / 2)
        return y * e, (1 - y**2) * e
    if fun == "cube":
        return y**3, 3 * y**2
    raise ValueError(f"unknown contrast function {fun!r}")


def turn_together(moments, begin: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """All directions, orthonormal after each step; ``moments(w)`` gives mean g(wz) z and mean g'(wz)."""
    w = decorrelate(begin)
    for done in range(1, max_iter + 1):
        gz, slope = moments(w)
        new = decorrelate(gz - slope[:, None] * w)
        moved = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max()
        w = new
        if moved < tol:
            return w, done
    warnings.warn("the rotation did not converge", stacklevel=3)
    return w, done


def turn_in_sequence(moments, begin: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """One direction after the other; the count of steps is that of the slowest."""
    found, most = np.zeros((0, begin.shape[1])), 0
    for start in begin:
        w = start / np.linalg.norm(start)
        for done in range(1, max_iter + 1):
            gz, slope = moments(w[None])
            new = gram_schmidt(gz[0] - slope[0] * w, found)
            new /= np.linalg.norm(new)
            moved, w = abs(abs(new @ w) - 1), new
            if moved < tol:
                break
        else:
            warnings.warn(f"direction {len(found) + 1} did not converge", stacklevel=3)
        found, most = np.vstack([found, w]), max(most, done)
    return found, most


def decorrelate(w: np.ndarray) -> np.ndarray:
    """Nearest orthonormal matrix."""
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def gram_schmidt(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``w`` without its parts along the orthonormal ``rows``."""
    return w - (rows @ w) @ rows if len(rows) else w


def resolve_components(asked: int | float | None, variance: np.ndarray) -> int:
    usable = int((variance > 1e-12 * variance[0]).sum())
    if isinstance(asked, int) and not isinstance(asked, bool):
        if not 1 < asked <= len(variance):
            raise ValueError("n_components must be above 1 and at most the number of channels")
        return min(asked, usable)
    share = 0.999999 if asked is None else float(asked)
    return min(usable, int(np.searchsorted(np.cumsum(variance) / variance.sum(), share) + 1))


def fixed_point_terms(ica: ICA, signal: DataFrame, fun: str = "logcosh", alpha: float = 1.0) -> DataFrame:
    """``recording_id, i, j, term``: mean of g(y_i) y_j, less the mean slope g'(y_i) where i = j, over sources y (from 1).

    One step of the fixed point takes the rotation W to the nearest orthonormal matrix of
    (term) W.  So a rotation found by turning all directions together has terms that are symmetric, one found
    direction by direction has terms that vanish for j > i; how far they are from that tells how far a
    fit is from its end, see :func:`fit_residual`.  Samples that lack a channel don't count.
    Sums of a batch meet by recording, components squared each.
    """
    w, offset = ica.to_sources()
    k = len(w)
    contrast(np.zeros(1), fun, alpha)
    vectors = sample_vectors(signal, ica.channels).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_i, at_j = (a.ravel() + 1 for a in np.indices((k, k)))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(1), len(ica.channels)) @ w.T + offset
            g, slope = contrast(y, fun, alpha)
            codes = batch.column(0).dictionary_encode()
            of, ids = codes.indices.to_numpy(), codes.dictionary
            rows, counts, sums = [], [], []
            for r in range(len(ids)):
                own = of == r
                term = g[own].T @ y[own] - np.diag(slope[own].sum(0))
                rows.append(np.full(k * k, r)), counts.append(np.full(k * k, int(own.sum()))), sums.append(term.ravel())
            cols = [ids.take(pa.array(np.concatenate(rows))), *[pa.array(np.tile(a, len(ids)).astype(np.int32)) for a in (at_i, at_j)], pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums))]
            yield pa.RecordBatch.from_arrays(cols, names=["recording_id", "i", "j", "n", "s"])

    parts = vectors.select("recording_id", "x").mapInArrow(run, f"recording_id {signal.schema['recording_id'].dataType.simpleString()}, i int, j int, n long, s double")
    return parts.groupBy("recording_id", "i", "j").agg((F.sum("s") / F.sum("n")).alias("term"))


def fit_residual(terms: DataFrame, algorithm: str = "parallel") -> DataFrame:
    """``component, residual``: the greatest part of a component's terms that the fixed point would still turn, near 0 at its end.

    ``terms`` of one recording, or of recordings fitted each by itself (then a row for each).
    """
    if algorithm not in ("parallel", "deflation"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if algorithm == "deflation":
        off = F.when(F.col("j") > F.col("i"), F.abs("term")).otherwise(0.0)
        return terms.groupBy("recording_id", F.col("i").alias("component")).agg(F.max(off).alias("residual"))
    # either order of a pair lands in one group, which holds two rows
    pairs = terms.groupBy("recording_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg((F.max("term") - F.min("term")).alias("off"))
    each = pairs.select("recording_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("component"), "off")
    return each.groupBy("recording_id", "component").agg(F.max("off").alias("residual"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A batch's arrays, all of ``width`` values, as a matrix; nulls are NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _weighted(signal: DataFrame, channels: list[str], weights: np.ndarray, offsets: np.ndarray, names: list[str], out: str) -> DataFrame:
    """Rows ``recording_id, sample_idx, out, value``: samples' channels are gathered once and multiplied as matrices.

    Missing values count as 0; samples that lack a channel's row, or every value, give no rows.
    """
    some = sample_vectors(signal, channels).where(F.exists("x", lambda v: v.isNotNull()))
    filled = some.select("recording_id", "sample_idx", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = (_matrix(batch.column(2), len(channels)) @ weights.T + offsets).ravel()
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(got))], names=["recording_id", "sample_idx", "y"])

    kinds = [f"{c} {signal.schema[c].dataType.simpleString()}" for c in ("recording_id", "sample_idx")]
    wide = filled.mapInArrow(run, f"{kinds[0]}, {kinds[1]}, y array<double>")
    named = F.array(*[F.lit(n) for n in names])
    return wide.select("recording_id", "sample_idx", F.posexplode("y").alias("_i", "value")).select("recording_id", "sample_idx", named[F.col("_i")].alias(out), "value")


def get_sources(ica: ICA, signal: DataFrame) -> DataFrame:
    """``recording_id, sample_idx, component, value`` with components IC1, IC2, ..."""
    w, offset = ica.to_sources()
    return _weighted(signal, ica.channels, w, offset, [f"IC{i + 1}" for i in range(len(w))], "component")


def _cleaned(ica: ICA, signal: DataFrame, exclude: list[int] | None) -> DataFrame:
    """``signal`` with ``_new``, values without the excluded sources, null where nothing changes; a sample's rows meet once, without a join."""
    w, offset = ica.cleaning(None if exclude is None else tuple(exclude))
    keys, width = ["recording_id", "sample_idx"], len(ica.channels)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(ica.channels) for v in (c, i)])
    gathered = signal.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in signal.columns if c not in keys])).alias("rows"))
    fitted = F.filter("rows", lambda r: r["channel"].isin(ica.channels))
    known = gathered.withColumn("x", F.transform(F.sort_array(F.transform(fitted, lambda r: F.struct(place[r["channel"]].alias("i"), r["value"].cast("double").alias("v")))), lambda s: s["v"]))
    whole = (F.size("x") == width) & F.exists("x", lambda v: v.isNotNull())
    filled = known.withColumn("x", F.when(whole, F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3)
            y = (_matrix(x.drop_null(), width) @ w.T + offset).ravel()
            cuts = np.concatenate([[0], np.cumsum(x.is_valid().to_numpy(zero_copy_only=False))]) * width
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(y, pa.float64()))], names=[*keys, "rows", "y"])

    kinds = ", ".join(f"{c} {filled.schema[c].dataType.simpleString()}" for c in (*keys, "rows"))
    rows = filled.mapInArrow(run, f"{kinds}, y array<double>").select(*keys, "y", F.inline("rows"))
    named = [*keys, "channel", *[c for c in signal.columns if c not in (*keys, "channel")]]
    return rows.select(*[F.col(c).cast(signal.schema[c].dataType) for c in named], F.get("y", place[F.col("channel")]).alias("_new"))


def apply_ica(ica: ICA, signal: DataFrame, exclude: list[int] | None = None) -> DataFrame:
    """Signal without the excluded sources; channels that weren't fitted stay as they are."""
    return _cleaned(ica, signal, exclude).withColumn("value", F.coalesce("_new", "value")).drop("_new")


def before_and_after(ica: ICA, signal: DataFrame, exclude: list[int] | None = None) -> DataFrame:
    """``recording_id, channel, sample_idx, before, after``: values with and without the excluded sources, which never part."""
    return _cleaned(ica, signal, exclude).select("recording_id", "channel", "sample_idx", F.col("value").alias("before"), F.coalesce("_new", "value").alias("after"))


def topographies(spark, ica: ICA) -> DataFrame:
    """``component, channel, weight``."""
    rows = [(f"IC{k}", c, float(v)) for k in range(1, ica.n_components + 1) for c, v in zip(ica.channels, ica.topography(k), strict=True)]
    return spark.createDataFrame(rows, "component string, channel string, weight double")


def component_summary(ica: ICA, signal: DataFrame, external: list[str]) -> DataFrame:
    """Per component: share of the variance of fitted channels, and correlation with each external channel."""
    sources = get_sources(ica, signal)
    weight = {f"IC{k}": float((ica.topography(k) ** 2).sum()) for k in range(1, ica.n_components + 1)}
    power = F.create_map(*[F.lit(v) for pair in weight.items() for v in pair])
    total = signal.where(F.col("channel").isin(ica.channels)).groupBy("recording_id", "channel").agg(F.var_samp("value").alias("v"))
    total = total.groupBy("recording_id").agg(F.sum("v").alias("_total"))
    var = sources.groupBy("recording_id", "component").agg(F.var_samp("value").alias("v")).join(total, "recording_id")
    out = var.select("recording_id", "component", (power[F.col("component")] * F.col("v") / F.col("_total")).alias("variance_share"))
    if not external:
        return out
    others = signal.where(F.col("channel").isin(external)).select("recording_id", "sample_idx", "channel", F.col("value").alias("x"))
    both = sources.join(others, ["recording_id", "sample_idx"])
    wide = both.groupBy("recording_id", "component").pivot("channel", external).agg(F.corr("value", "x"))
    return out.join(wide.select("recording_id", "component", *[F.col(f"`{c}`").alias(f"corr_{c}") for c in external]), ["recording_id", "component"])
