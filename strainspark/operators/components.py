"""Principal components of a large sparse matrix by a random range finder, projections, and the number of significant ones.

Rows stay where they are, a sparse row each; what is held of the genes is a factor of
genes by components, whose size is checked.  Every pass multiplies the standardised
matrix and its transpose with such a factor; the means are taken out in the products,
so the matrix stays sparse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.operators.ordering import in_order
from strainspark.scratch import Scratch

#: Numbers of a factor that the driver and the workers hold, 8 bytes each; genes of a block of partial sums.
MOST_NUMBERS, BLOCK = 1 << 25, 512


class Standardised:
    """Sparse rows (sample, at, x) of (sample, gene, value), with every gene's mean and deviation; absent values are 0.

    Genes without deviation and null values are left out.  ``genes``: (gene, at), places from 0.
    """

    def __init__(self, matrix: DataFrame, scratch: Scratch, scale: bool = True):
        self.scratch = scratch
        values = matrix.filter("value IS NOT NULL").select("sample", "gene", F.col("value").cast("double").alias("value"))
        self.n = values.select("sample").distinct().count()
        sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
        mean, n = F.col("s") / F.lit(max(1, self.n)), F.lit(max(2, self.n))
        spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0)) / (n - 1))
        known = sums.select("gene", mean.alias("mean"), spread.alias("sd")).filter(F.col("sd") > 1e-9 * F.greatest(F.abs("mean"), F.lit(1e-300)))
        self.genes = scratch.keep(in_order(known, [F.asc("gene")], scratch, "order").select("gene", (F.col("place") - 1).cast("int").alias("at"), "mean", "sd"), "genes")
        held = self.genes.count()
        if held * 2 > MOST_NUMBERS:
            raise ValueError(f"{held} genes are too many for the factors held in memory")
        stats = self.genes.orderBy("at").collect()  # two numbers a gene, bounded above
        self.mean, self.sd = np.array([r["mean"] for r in stats]), np.array([r["sd"] if scale else 1.0 for r in stats])
        rows = values.join(self.genes.select("gene", "at"), "gene").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("r"))
        self.rows = scratch.keep(rows.select("sample", F.transform("r", lambda x: x["at"]).alias("at"), F.transform("r", lambda x: x["value"]).alias("x")), "rows")

    def _checked(self, columns: int) -> None:
        if len(self.mean) * columns > MOST_NUMBERS:
            raise ValueError(f"{len(self.mean)} genes by {columns} components are too many")

    def product(self, factor: np.ndarray) -> DataFrame:
        """(sample, y): each standardised row times ``factor`` (genes by columns)."""
        held = self.rows.sparkSession.sparkContext.broadcast((factor / self.sd[:, None], (self.mean / self.sd) @ factor))
        kind = dict(self.rows.dtypes)["sample"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, shift = held.value
            for batch in batches:
                yield pd.DataFrame({"sample": batch["sample"], "y": list(_times(batch, f) - shift)})

        return self.rows.mapInPandas(run, f"sample {kind}, y array<double>")

    def gram_product(self, factor: np.ndarray) -> np.ndarray:
        """The transposed standardised matrix times itself times ``factor``: one pass, partial sums by blocks of genes."""
        self._checked(factor.shape[1])
        held = self.rows.sparkSession.sparkContext.broadcast((factor / self.sd[:, None], (self.mean / self.sd) @ factor))
        g, width = factor.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, shift = held.value
            total, ys = np.zeros((g, width)), np.zeros(width)
            for batch in batches:
                y = _times(batch, f) - shift
                ys += y.sum(axis=0)
                sizes = batch["at"].map(len).to_numpy()
                if sizes.sum():
                    np.add.at(total, np.concatenate(batch["at"].to_numpy()), np.concatenate(batch["x"].to_numpy())[:, None] * np.repeat(y, sizes, axis=0))
            yield _blocks(np.vstack([total, ys]))

        sums = self._summed(run, width)
        return (sums[:g] - self.mean[:, None] * sums[g]) / self.sd[:, None]

    def _summed(self, run, width: int) -> np.ndarray:
        """Sums of the workers' blocks; what comes back has the size of a factor."""
        partial = self.rows.mapInPandas(run, "block int, part binary")
        added = partial.groupBy("block").applyInPandas(_added, "block int, part binary").collect()
        return np.concatenate([np.frombuffer(r["part"]).reshape(-1, width) for r in sorted(added, key=lambda r: r["block"])])

    def permuted_products(self, factors: np.ndarray, seed: int) -> np.ndarray:
        """``gram_product`` of each of the ``factors`` (permutations, genes, columns) with the rows' values permuted among the genes.

        A row's permutation is drawn from (seed, permutation, row's hash), so it is the
        same in every pass; rows are permuted where they are, a batch at a time.
        """
        b, g, width = factors.shape
        self._checked(b * width)
        held = self.rows.sparkSession.sparkContext.broadcast((factors, self.mean, self.sd))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, mean, sd = held.value
            total = np.zeros((b, g, width))
            for batch in batches:
                for at, x, key in zip(batch["at"], batch["x"], batch["key"], strict=True):
                    z = np.zeros(g)
                    z[at] = x
                    z = (z - mean) / sd
                    draw = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF])
                    for k in range(b):
                        own = draw.permutation(z)
                        total[k] += np.outer(own, own @ f[k])
            yield _blocks(total.reshape(b * g, width))

        rows, self.rows = self.rows, self.rows.withColumn("key", F.xxhash64("sample"))
        try:
            return self._summed(run, width).reshape(b, g, width)
        finally:
            self.rows = rows


def _times(batch: pd.DataFrame, factor: np.ndarray) -> np.ndarray:
    """Sparse rows times a factor."""
    sizes = batch["at"].map(len).to_numpy()
    out = np.zeros((len(batch), factor.shape[1]))
    if sizes.sum():
        terms = factor[np.concatenate(batch["at"].to_numpy())] * np.concatenate(batch["x"].to_numpy())[:, None]
        full = np.flatnonzero(sizes)
        out[full] = np.add.reduceat(terms, (np.cumsum(sizes) - sizes)[full])
    return out


def _blocks(x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": range(-(-len(x) // BLOCK)), "part": [np.ascontiguousarray(x[k : k + BLOCK]).tobytes() for k in range(0, len(x), BLOCK)]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [np.sum([np.frombuffer(x) for x in pdf["part"]], axis=0).tobytes()]})


def random_pca(matrix: DataFrame, k: int, scratch: Scratch, scale: bool = True, oversample: int = 10, passes: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores, loadings, singular values) of the k leading components of (sample, gene, value), centred and scaled by gene.

    scores: (sample, y); loadings: (gene, v).  A random factor of k + oversample columns
    is multiplied with the matrix and its transpose ``passes`` times, made orthonormal
    in between; its span then holds the leading components.  Each component's largest
    loading is positive.
    """
    z = Standardised(matrix, scratch, scale)
    q, image = _range(lambda f: z.gram_product(f), len(z.mean), min(k + oversample, len(z.mean)), passes, np.random.default_rng(seed))
    values, turn = np.linalg.eigh(q.T @ image)
    top = np.argsort(-values)[:k]
    v = q @ turn[:, top]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    loadings = z.rows.sparkSession.createDataFrame(list(enumerate(v.tolist())), "at int, v array<double>")  # a factor's size
    return z.product(v), z.genes.select("gene", "at").join(loadings, "at").select("gene", "v"), np.sqrt(np.maximum(values[top], 0))


def _range(multiply, genes: int, width: int, passes: int, rng) -> tuple[np.ndarray, np.ndarray]:
    q = np.linalg.qr(rng.normal(size=(genes, width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(multiply(q))[0]
    return q, multiply(q)


def significant_components(matrix: DataFrame, k: int, scratch: Scratch, permutations: int = 20, level: float = 0.05, passes: int = 3, seed: int = 1) -> tuple[int, list[float]]:
    """(number, p) of the k leading components: the share of permutations in which a component explains as much of all k.

    Permutations move each row's standardised values among the genes.  p never falls
    from one component to the next; the number is of those up to ``level``.  All
    permutations go through the rows together, pass by pass.
    """
    z = Standardised(matrix, scratch)
    g, rng = len(z.mean), np.random.default_rng(seed)
    width = min(k + 5, g)

    def shares(q: np.ndarray, image: np.ndarray) -> np.ndarray:
        values = np.sort(np.linalg.eigvalsh(q.T @ image))[::-1][:k]
        return values / values.sum()

    seen = shares(*_range(z.gram_product, g, width, passes, rng))
    q = np.stack([np.linalg.qr(rng.normal(size=(g, width)))[0] for _ in range(permutations)])
    for _ in range(passes):
        q = np.stack([np.linalg.qr(x)[0] for x in z.permuted_products(q, seed)])
    image = z.permuted_products(q, seed)
    null = np.stack([shares(a, b) for a, b in zip(q, image, strict=True)])
    p = np.maximum.accumulate((null >= seen).mean(axis=0)).tolist()
    return sum(x <= level for x in p), p


def projected(matrix: DataFrame, genes: DataFrame, loadings: DataFrame) -> DataFrame:
    """(sample, y): rows of (sample, gene, value) standardised by ``genes`` (gene, mean, sd), times ``loadings`` (gene, v).

    An absent value is 0; genes that aren't in both are left out.
    """
    both = genes.join(loadings, "gene")
    wide = both.select("gene", "mean", "sd", F.posexplode("v").alias("place", "v"))
    shift = wide.groupBy("place").agg(F.sum(F.col("mean") / F.col("sd") * F.col("v")).alias("shift"))
    sums = matrix.join(wide, "gene").groupBy("sample", "place").agg(F.sum(F.col("value") / F.col("sd") * F.col("v")).alias("y"))
    every = matrix.select("sample").distinct().crossJoin(F.broadcast(shift))  # one row a component
    y = every.join(sums, ["sample", "place"], "left").select("sample", "place", (F.coalesce("y", F.lit(0.0)) - F.col("shift")).alias("y"))
    return y.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "y"))), lambda x: x["y"]).alias("y"))
