"""Roles of entities: compositional features, clusters with stability, neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import MultivariateGaussian
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import log_shares
from tidemark.operators.resampling import copies
from tidemark.sources.shared import kept

# Variance kept, clusters, starts, stability floor and draws, neighbours, least period.
VARIANCE, CLUSTERS, STARTS, STABLE, DRAWS, NEIGHBOURS, MIN_PERIOD, BLOCK = 0.90, 5, 5, 0.45, 12, 10, 3, 2048
#: Pivots of a period, at most.
PIVOTS = 64
#: Rows that meet a block, or a period's pivots, at once.
SLICE = 512


def feature_frame(df: DataFrame, parts: list[str], features: list[str], weight: str, least: float) -> DataFrame:
    """Rows of enough weight and complete features, with clr_<part> columns."""
    rows = df.where(F.col(weight) >= least).dropna(subset=[*parts, *features])
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    shares = rows.where(total > 0).withColumns({f"share_{p}": F.col(p) / total for p in parts})
    return shares.withColumns({f"clr_{p}": c for p, c in zip(parts, log_shares([f"share_{p}" for p in parts]), strict=True)})


def reduce_dimensions(df: DataFrame, columns: list[str], variance: float = VARIANCE) -> tuple[DataFrame, int]:
    """Principal components (not whitened) that keep ``variance``; column ``pcs``.
    ``columns`` are standardised already."""
    vectors = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    model = PCA(k=len(columns), inputCol="__v", outputCol="__p").fit(vectors)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), variance - 1e-12) + 1)
    k = min(k, len(columns))
    cut = PCA(k=k, inputCol="__v", outputCol="pcs").fit(vectors)
    return cut.transform(vectors).drop("__v"), k


#: EM's rounds at most, the gain of log-likelihood that ends it, and what keeps a density above 0.
ROUNDS, GAIN, LEAST = 60, 0.01, 2.0**-52


@dataclass
class Fit:
    """A Gaussian mixture: ``weights``, ``gaussians`` and ``summary.logLikelihood`` of the last round."""

    weights: list[float]
    gaussians: list[MultivariateGaussian]
    summary: SimpleNamespace

    def forms(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Per component: log of its density's constant, its mean, and a root of its inverse covariance."""
        out = []
        for g in self.gaussians:
            values, axes = np.linalg.eigh(g.cov.toArray())
            held = values > LEAST * values.max() * len(values)
            if not held.any():
                raise ValueError("a component's covariance has no positive eigenvalue")
            root = axes * np.where(held, 1 / np.sqrt(np.where(held, values, 1.0)), 0.0)
            out.append((-0.5 * (len(values) * np.log(2 * np.pi) + float(np.log(values[held]).sum())), g.mean.toArray(), root))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", F.get(labels([self]), F.lit(0)))


def labels(fits: list[Fit], pcs: str = "pcs") -> Column:
    """array<int>: the likeliest component of a row in each of the mixtures."""
    sent = [(np.array(f.weights), f.forms()) for f in fits]

    @F.arrow_udf("array<int>")
    def likeliest(v: pa.Array) -> pa.Array:
        x = np.asarray(v.flatten()).reshape(len(v), -1)
        found = np.stack([np.stack([LEAST + share * np.exp(base - 0.5 * (((x - mean) @ root) ** 2).sum(1)) for share, (base, mean, root) in zip(weights, forms, strict=True)], axis=1).argmax(axis=1) for weights, forms in sent], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(sent)), pa.array(found.ravel().astype(np.int32)))

    return likeliest(vector_to_array(pcs))


def mixtures(df: DataFrame, starts: list[tuple[int, int]], counts: Column | None = None) -> list[Fit]:
    """Gaussian mixtures, one for each (clusters, seed). ``counts``: an array with what a row counts in
    each of them; rows of 0 are left out.

    All take their rounds together: a round is one pass over the rows, whose tasks return the sums
    of every mixture that has not converged, however many there are."""
    counted = counts is not None
    columns = [counts.cast("array<double>").alias("__w")] if counted else []
    rows = df.select("pcs", vector_to_array("pcs").alias("__v"), *columns).persist()
    state = []
    for i, (k, seed) in enumerate(starts):
        first = GaussianMixture(k=k, featuresCol="pcs", seed=seed, maxIter=0, **({"weightCol": "__k"} if counted else {}))
        model = first.fit(rows.withColumn("__k", F.get("__w", F.lit(i))).where("__k > 0") if counted else rows)
        state.append(Fit(list(model.weights), list(model.gaussians), SimpleNamespace(logLikelihood=-np.finfo(float).max)))
    active = list(range(len(starts)))
    for _ in range(ROUNDS):
        if not active:
            break
        asked = [(i, np.array(state[i].weights), state[i].forms()) for i in active]

        def sums(batches: Iterator[pa.RecordBatch], asked: list = asked) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = np.asarray(batch.column(0).flatten()).reshape(n, -1)
                w = np.asarray(batch.column(1).flatten()).reshape(n, -1) if counted else None
                d = x.shape[1]
                # per component the sums of 1, x and x x', as one product
                wide = np.hstack([np.ones((n, 1)), x, (x[:, :, None] * x[:, None, :]).reshape(n, d * d)])
                parts = []
                for i, weights, forms in asked:
                    chance = np.stack([LEAST + share * np.exp(base - 0.5 * (((x - mean) @ root) ** 2).sum(1)) for share, (base, mean, root) in zip(weights, forms, strict=True)], axis=1)
                    whole = chance.sum(1)
                    own = np.ones(n) if w is None else w[:, i]
                    parts.append(np.append((chance * (own / whole)[:, None]).T @ wide, np.log(whole) @ own))
                part = np.concatenate(parts)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        found = rows.select("__v", *(["__w"] if counted else [])).mapInArrow(sums, "sums array<double>").collect()
        total, at, still = np.sum([r.sums for r in found], axis=0), 0, []
        for i, weights, forms in asked:
            k, d = len(weights), len(forms[0][1])
            own = total[at : at + k * (1 + d + d * d)].reshape(k, -1)
            at += own.size + 1
            means = own[:, 1 : 1 + d] / own[:, :1]
            covs = own[:, 1 + d :].reshape(k, d, d) / own[:, :1, None] - means[:, :, None] * means[:, None, :]
            before, now = state[i].summary.logLikelihood, float(total[at - 1])
            gaussians = [MultivariateGaussian(DenseVector(m), DenseMatrix(d, d, c.ravel())) for m, c in zip(means, covs, strict=True)]
            state[i] = Fit((own[:, 0] / own[:, 0].sum()).tolist(), gaussians, SimpleNamespace(logLikelihood=now))
            if abs(now - before) > GAIN:
                still.append(i)
        active = still
    rows.unpersist()
    return state


def mixture(df: DataFrame, k: int = CLUSTERS, starts: int = STARTS, seed: int = 1, weight: str | None = None) -> Fit:
    """The best of several Gaussian mixtures by log-likelihood; a row counts ``weight`` times."""
    counts = F.array_repeat(F.col(weight), starts) if weight else None
    return max(mixtures(df, [(k, seed + i) for i in range(starts)], counts), key=lambda m: m.summary.logLikelihood)


def held_out_log_likelihood(df: DataFrame, time: str, candidates: list[int], quantile: float = 0.75, seed: int = 1) -> list[tuple[int, float]]:
    """Mean log-likelihood of rows later than the time quantile, per k."""
    cut = df.agg(F.percentile(time, quantile)).first()[0]
    train, test = df.where(F.col(time) <= cut), df.where(F.col(time) > cut)
    scores = []
    for model in mixtures(train, [(k, seed) for k in candidates]):
        parts = [(w, g.mean.toArray(), g.cov.toArray()) for w, g in zip(model.weights, model.gaussians, strict=True)]
        sets = [(float(np.log(max(w, 1e-300)) - 0.5 * (len(m) * np.log(2 * np.pi) + np.linalg.slogdet(c + 1e-9 * np.eye(len(m)))[1])), m, np.linalg.pinv(c)) for w, m, c in parts]
        v = vector_to_array("pcs")
        terms = []
        for base, m, inv in sets:
            d = [F.get(v, i) - float(m[i]) for i in range(len(m))]
            quad = sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(m)) for j in range(len(m))), F.lit(0.0))
            terms.append(F.lit(base) - 0.5 * quad)
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        scores.append(top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0))))
    found = test.agg(*[F.avg(score) for score in scores]).first()  # one pass for all
    return list(zip(candidates, found, strict=True))


def jaccard_best(pairs: DataFrame) -> DataFrame:
    """(cluster, jaccard): the best overlap of each cluster with any of another
    labelling. ``pairs``: cluster, other of the same rows."""
    both = pairs.groupBy("cluster", "other").agg(F.count("*").alias("n"))
    a, b = pairs.groupBy("cluster").agg(F.count("*").alias("na")), pairs.groupBy("other").agg(F.count("*").alias("nb"))
    return both.join(a, "cluster").join(b, "other").groupBy("cluster").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def stability(df: DataFrame, labelled: DataFrame, key: list[str], k: int = CLUSTERS, draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """(cluster, stability): mean best Jaccard overlap over refits on draws of as many rows,
    with replacement. ``key`` tells rows apart."""
    drawn = df.join(copies(df, key, draws, seed), key)
    refits = mixtures(drawn, [(k, seed + d) for d in range(draws)], F.col("copies"))
    others = df.select(*key, F.posexplode(labels(refits)).alias("draw", "other"))
    pairs = labelled.select(*key, "cluster").join(others, key)
    both = pairs.groupBy("draw", "cluster", "other").agg(F.count("*").alias("n"))
    of = lambda c: F.sum("n").over(Window.partitionBy("draw", c))
    best = both.select("draw", "cluster", (F.col("n") / (of("cluster") + of("other") - F.col("n"))).alias("jaccard")).groupBy("draw", "cluster").agg(F.max("jaccard").alias("jaccard"))
    return best.groupBy("cluster").agg(F.avg("jaccard").alias("stability")).withColumn("reportable", F.col("stability") >= STABLE)


def describe_clusters(labelled: DataFrame, columns: list[str], id_col: str, weight: str, top: int = 4, exemplars: int = 5) -> DataFrame:
    """Per cluster: its size, its ``top`` largest mean deviations and its heaviest members."""
    means = labelled.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    traits = F.slice(F.reverse(F.array_sort(F.array(*[F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]))), 1, top)
    members = labelled.withColumn("__n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col(weight).desc(), id_col))).where(F.col("__n") <= exemplars)
    members = members.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", id_col))), lambda s: s[id_col].cast("string")).alias("exemplars"))
    return means.select("cluster", "n", F.transform(traits, lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"))).alias("traits")).join(members, "cluster")


def _nearest(k: int):
    """Of a block and the rows that ask it, block first: its ``k`` nearest for each of them. Pieces of
    SLICE asking rows meet pieces of BLOCK rows, so memory does not grow with the number that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_rows: list[pa.RecordBatch] = []
        held = None
        for batch in batches:
            asks = batch["__asks"].to_numpy(zero_copy_only=False)
            n = int((~asks).sum())
            if n and (held is not None or asks[:n].any()):
                raise ValueError("rows of a block came after those that ask it")
            if n:
                kept_rows.append(batch.slice(0, n))
            if n < batch.num_rows and held is None:
                whole = pa.Table.from_batches(kept_rows, batch.schema).combine_chunks()
                held = [(whole["__id"][at : at + BLOCK].to_numpy(), _matrix(whole["__v"][at : at + BLOCK].combine_chunks())) for at in range(0, whole.num_rows, BLOCK)]
                kept_rows = []
            for at in range(n, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                ids, x = piece["__id"].to_numpy(zero_copy_only=False), _matrix(piece["__v"])
                met = [(i, others[j], gap) for others, y in held for i, j, gap in [_closest(ids, x, others, y, k)]]
                i, other, gap = _first(*[np.concatenate(c) for c in zip(*met, strict=True)], k) if met else ([], [], [])
                yield pa.RecordBatch.from_arrays([piece["__g"].take(pa.array(i, pa.int64())), piece["__id"].take(pa.array(i, pa.int64())), pa.array(other, piece["__id"].type), pa.array(gap, pa.float64())], ["__g", "__id", "neighbour", "distance"])

    return run


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def _first(i: np.ndarray, other: np.ndarray, gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row ``i``; ties go to the smaller id."""
    order = np.lexsort((other, gap, i))
    i, other, gap = i[order], other[order], gap[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], other[nth < k], gap[nth < k]


def _closest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``x``, places in ``y`` and distances of all that could be among the ``k`` nearest."""
    a, b = x.astype(float), y.astype(float)
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)
    rough = sizes - 2 * a @ b.T
    rough[ids[:, None] == others] = np.inf
    # products round: everything that could be among the nearest is measured again
    edge = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
    i, j = np.nonzero((rough <= (edge + 1e-5 * sizes.max(1))[:, None]) & np.isfinite(rough))
    gap = np.concatenate([np.sqrt(((x[i[at : at + 65536]] - y[j[at : at + 65536]]).astype(float) ** 2).sum(1)) for at in range(0, max(len(i), 1), 65536)])
    order = np.lexsort((others[j], gap, i))
    i, j, gap = i[order], j[order], gap[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], gap[nth < k]


def neighbours(df: DataFrame, id_col: str, vector: str, period: str, k: int = NEIGHBOURS, block: int = BLOCK, of: Column | None = None) -> DataFrame:
    """The ``k`` nearest (Euclid) other rows of the same period: id_col, neighbour,
    distance, rank. Exact; ties go to the smaller id. ``of``: the rows that are asked for
    (all where it is not given). Rows without a vector have no neighbours.

    Rows lie in blocks (``Blocks``). A row's k nearest in its own block bound the distance to
    the k-th neighbour; it then meets only those other blocks that the triangle inequality does
    not put beyond that bound. A task holds one block, and the rows that ask it stream past in
    slices, whose matrix products leave k rows for each row that asks; only these become rows,
    and meet once more."""
    sizes = df.groupBy(period).agg(F.count("*").alias("__size")).where(F.col("__size") >= MIN_PERIOD)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(period).alias("__g"), F.col(id_col).alias("__id"), F.col(vector).alias("__v"), (F.lit(True) if of is None else of).alias("__of"))
    blocks = Blocks.of(rows.join(sizes.withColumnRenamed(period, "__g"), "__g"), block)
    near = blocks.near(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("__g", "__id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select(F.col("__g").alias(period), F.col("__id").alias(id_col), "neighbour", "distance", "rank")


@dataclass
class Blocks:
    """The rows of each period in blocks of about one size: cells of the nearest pivot, of which
    a period has PIVOTS at most, and in a cell rings of like distance from the pivot.

    ``rows``: __g, __id, __v, __of, __cell, __ring. ``pivots`` ({period: vectors}) and ``rings``
    ({period: cell, ring, nearest and farthest row}) are on the driver: PIVOTS rows a period
    and one a block."""

    rows: DataFrame
    pivots: dict
    rings: dict

    @classmethod
    def of(cls, rows: DataFrame, block: int) -> Blocks:
        order = Window.partitionBy("__g").orderBy(F.xxhash64("__id"), "__id")
        wanted = F.least(F.ceil(F.col("__size") / block), F.lit(PIVOTS))
        largest = rows.agg(F.max("__size")).first()[0] or 0
        if largest <= block:  # every period is one block: there is nothing to leave out
            return cls(rows.select("__g", "__id", "__v", "__of", F.lit(0).alias("__cell"), F.lit(0).alias("__ring")), {}, {})
        picked = rows.select("__g", "__id", "__v", "__size").withColumn("__n", F.row_number().over(order)).where((F.col("__n") <= PIVOTS) & (F.col("__n") <= wanted)).collect()
        pivots: dict = {}
        for r in picked:
            pivots.setdefault(r["__g"], []).append(r["__v"])
        pivots = {g: np.array(v, float) for g, v in pivots.items()}
        kinds = dict(rows.dtypes)
        sent = rows.sparkSession.sparkContext.broadcast(pivots)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for i, gaps in _to_pivots(batch, sent.value):
                    cell[i] = gaps.argmin(axis=1)
                    apart[i] = gaps[np.arange(len(i)), cell[i]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], [*batch.schema.names, "__cell", "__apart"])

        fields = ("__g", "__id", "__v", "__of")
        told = kept(rows.select(*fields).mapInArrow(placed, ", ".join(f"{c} {kinds[c]}" for c in fields) + ", __cell int, __apart double"))
        # cuts at about equal numbers; any cuts will do, so a sketch of the distances is enough
        n_cuts = 512
        cells = told.groupBy("__g", "__cell").agg(F.count("*").alias("__n"), F.percentile_approx("__apart", [(i + 1) / n_cuts for i in range(n_cuts - 1)], 10_000).alias("__cuts"))
        step = F.greatest(F.lit(1), F.floor(F.lit(n_cuts) * block / F.col("__n")))
        cells = cells.select("__g", "__cell", F.array_distinct(F.filter("__cuts", lambda x, i: (i + 1) % step == 0)).alias("__cuts"))
        ring = F.size(F.filter("__cuts", lambda x: x < F.col("__apart")))
        told = kept(told.join(cells, ["__g", "__cell"]).withColumn("__ring", ring).drop("__cuts"))
        rings: dict = {}
        for r in told.groupBy("__g", "__cell", "__ring").agg(F.min("__apart").alias("lo"), F.max("__apart").alias("hi"), F.count("*").alias("n")).collect():
            rings.setdefault(r["__g"], []).append((r["__cell"], r["__ring"], r.lo, r.hi, r.n))
        return cls(told, pivots, {g: np.array(sorted(v)) for g, v in rings.items()})

    def _meet(self, asked: DataFrame, k: int) -> DataFrame:
        """``asked``: __g, __id, __v and the block that each row meets."""
        key, kinds = ["__g", "__cell", "__ring"], dict(self.rows.dtypes)
        side = lambda df, asks: df.select(*key, F.lit(asks).alias("__asks"), "__id", "__v")
        # the block before those that ask it: it is held, they stream past
        both = side(self.rows, False).union(side(asked, True)).repartition(*key).sortWithinPartitions(*key, "__asks")
        return both.groupBy(*key).applyInArrow(_nearest(k), f"__g {kinds['__g']}, __id {kinds['__id']}, neighbour {kinds['__id']}, distance double")

    def near(self, k: int) -> DataFrame:
        """__g, __id, neighbour, distance: k or more of each asked row, the nearest among them."""
        if not self.rings:
            return self._meet(self.rows.where("__of").select("__g", "__id", "__v", "__cell", "__ring"), k)
        own = kept(self._meet(self.rows.where("__of").select("__g", "__id", "__v", "__cell", "__ring"), k))
        return own.union(self._meet(self.visits(own, k), k))

    def visits(self, own: DataFrame, k: int) -> DataFrame:
        """__g, __id, __v and each other block that may hold a neighbour. ``own``: the nearest
        in the row's own block. A block lies at least as far away as the row's distance from the
        block's pivot leaves the ring, and as the border between the two pivots' cells."""
        bound = own.groupBy("__g", "__id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("__most"))
        asked = self.rows.where("__of").join(bound, ["__g", "__id"], "left").select("__g", "__id", "__v", "__cell", "__ring", F.coalesce("__most", F.lit(float("inf"))).alias("__most"))
        sent = self.rows.sparkSession.sparkContext.broadcast((self.pivots, self.rings))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, rings = sent.value
            for batch in batches:
                cell, ring, most = (batch.column(c).to_numpy() for c in (3, 4, 5))
                for i, gaps in _to_pivots(batch, pivots):
                    g = batch.column(0)[int(i[0])].as_py()
                    to, nth, lo, hi, _ = rings[g].T
                    to = to.astype(int)
                    far = np.maximum(gaps[:, to] - hi, lo - gaps[:, to])
                    between = np.sqrt(np.maximum(((pivots[g][:, None] - pivots[g][None]) ** 2).sum(2), 0))[cell[i][:, None], to[None]]
                    own = gaps[np.arange(len(i)), cell[i]][:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        border = np.where(between > 0, (gaps[:, to] ** 2 - own**2) / (2 * between), 0.0)
                    slack = 1e-9 * (1 + gaps[:, to] + own)
                    other = (to[None] != cell[i][:, None]) | (nth[None] != ring[i][:, None])
                    row, block = np.nonzero(other & (np.maximum(far, border) <= most[i][:, None] + slack))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(i[row])) for c in range(3)], pa.array(to[block].astype(np.int32)), pa.array(nth[block].astype(np.int32))], ["__g", "__id", "__v", "__cell", "__ring"])

        kinds = dict(self.rows.dtypes)
        return asked.mapInArrow(run, f"__g {kinds['__g']}, __id {kinds['__id']}, __v {kinds['__v']}, __cell int, __ring int")

    def compared(self, k: int) -> float:
        """The share of all ordered pairs of a period whose distance is computed."""
        size = {(g, c, r): n for g, x in self.rings.items() for c, r, _, _, n in x.tolist()}
        own = self._meet(self.rows.where("__of").select("__g", "__id", "__v", "__cell", "__ring"), k)
        blocks = self.rows.where("__of").select("__g", "__cell", "__ring").union(self.visits(own, k).select("__g", "__cell", "__ring"))
        met = sum(r["n"] * size[r["__g"], r["__cell"], r["__ring"]] for r in blocks.groupBy("__g", "__cell", "__ring").agg(F.count("*").alias("n")).collect())
        every = {g: x[:, 4].sum() for g, x in self.rings.items()}
        asked = {r["__g"]: r["n"] for r in self.rows.where("__of").groupBy("__g").agg(F.count("*").alias("n")).collect()}
        return met / sum(n * every[g] for g, n in asked.items())


def _to_pivots(batch: pa.RecordBatch, pivots: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one period of a batch (g, id, vector first), and their distances to its pivots."""
    groups: dict = {}
    for i, g in enumerate(batch.column(0).to_pylist()):
        groups.setdefault(g, []).append(i)
    for g, own in groups.items():
        own = np.array(own)
        v = np.asarray(batch.column(2).take(pa.array(own)).flatten()).reshape(len(own), -1).astype(float)
        for a in range(0, len(own), SLICE):
            yield own[a : a + SLICE], np.sqrt(((v[a : a + SLICE, None] - pivots[g][None]) ** 2).sum(2))
