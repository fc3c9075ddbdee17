"""Two-part models with covariates: whether a value is detected, and how high it is where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.functions.special import chi_square_tail
from strainspark.operators.ordering import adjusted_over_all
from strainspark.scratch import Scratch

#: Covariate patterns that the workers hold as a matrix.
MOST_PATTERNS = 200_000
#: Genes times patterns that are fitted at once.
CELLS = 500_000


def _products(x: np.ndarray) -> np.ndarray:
    """Of each pattern the products of its covariates, in a row; weights by pattern times these are Gram matrices."""
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _solved(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares from a row of a Gram matrix and one of cross products, the shortest of equals."""
    width = cross.shape[1]
    return (np.linalg.pinv(gram.reshape(-1, width, width), rcond=1e-12, hermitian=True) @ cross[:, :, None])[:, :, 0]


def _logistic(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, log-likelihood), a row a gene, by reweighted least squares; steps are halved where they don't help."""
    beta, products = np.zeros((len(k), x.shape[1])), _products(x)

    def value(b: np.ndarray, k: np.ndarray) -> np.ndarray:
        eta = b @ x.T
        return (k * eta - n * np.logaddexp(0, eta)).sum(axis=1)

    best, moving = value(beta, k), np.arange(len(k))
    for _ in range(60):
        if not len(moving):
            break
        own, at, was = k[moving], beta[moving], best[moving]
        p = 1 / (1 + np.exp(-np.clip(at @ x.T, -35, 35)))
        w = np.maximum(n * p * (1 - p), 1e-12)
        step, size = _solved(w @ products, (own - n * p) @ x), np.ones(len(at))
        while (worse := (size > 1e-6) & (value(at + size[:, None] * step, own) < was - 1e-12)).any():
            size[worse] /= 2
        beta[moving] = at + size[:, None] * step
        now = value(beta[moving], own)
        done = np.abs(now - was) < 1e-10 * (1 + np.abs(was))
        best[moving] = np.where(done, np.maximum(now, was), now)
        moving = moving[~done]
    return beta, best


def _normal(x: np.ndarray, k: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, log-likelihood, what is left of the squares), a row a gene, of least squares from each pattern's number and sum, and the sum of squares."""
    cross, n = s @ x, k.sum(axis=1)
    beta = _solved(k @ _products(x), cross)
    left = q - (beta * cross).sum(axis=1)
    return beta, -0.5 * n * (np.log(np.maximum(left, 1e-300) / n * 2 * np.pi) + 1), left


def _tests(design: pd.DataFrame, covariates: list[str], dropped: list[str]):
    """Fits of the genes of rows (gene, pattern, k, s, q) in order of genes, many genes at once."""
    x = np.column_stack([np.ones(len(design)), design[covariates].to_numpy(float)])
    sizes, keep = design["size"].to_numpy(float), [0] + [1 + j for j, c in enumerate(covariates) if c not in dropped]
    first = 1 + covariates.index(dropped[0])
    rank = np.linalg.matrix_rank
    df_d = int(rank(x) - rank(x[:, keep]))
    together = max(1, CELLS // len(x))

    def fitted(gene: np.ndarray, pattern: np.ndarray, k_rows: np.ndarray, s_rows: np.ndarray, q_rows: np.ndarray) -> list[np.ndarray]:
        k, s = np.zeros((gene[-1] + 1, len(x))), np.zeros((gene[-1] + 1, len(x)))
        k[gene, pattern], s[gene, pattern] = k_rows, s_rows
        q = np.bincount(gene, q_rows, len(k))
        (bd, ld), (_, ld0) = _logistic(x, k, sizes), _logistic(x[:, keep], k, sizes)
        d = np.maximum(2 * (ld - ld0), 0.0)
        (bc, lc, left), (_, lc0, _) = _normal(x, k, s, q), _normal(x[:, keep], k, s, q)
        # Genes detected in the same patterns share their ranks.
        kinds, kind = np.unique(np.packbits(k > 0, axis=1), axis=0, return_inverse=True)
        seen = [np.unpackbits(bits, count=len(x)).astype(bool) for bits in kinds]
        ranks = np.array([(rank(x[at]), rank(x[at][:, keep])) for at in seen])[kind.ravel()]
        df_c, detected = ranks[:, 0] - ranks[:, 1], k.sum(axis=1)
        level = (df_c > 0) & (detected > ranks[:, 0]) & (left > 1e-9 * np.maximum(q, 1e-300))
        c = np.where(level, np.maximum(2 * (lc - lc0), 0.0), np.nan)
        tails = lambda v, df: np.array([chi_square_tail(a, b) for a, b in zip(v.tolist(), df.tolist(), strict=True)], float)
        flat = np.full(len(k), df_d)
        return [detected.astype(np.int64), bd[:, first] if df_d else np.full(len(k), np.nan), tails(d, flat), np.where(level, bc[:, first], np.nan), tails(c, df_c), tails(d + c, flat + df_c)]

    def fit(rows: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [rows[c].to_numpy() for c in ("pattern", "k", "s", "q")]
        for low in range(0, codes[-1] + 1, together):
            a, b = np.searchsorted(codes, [low, low + together])
            found = fitted(codes[a:b] - low, *[c[a:b] for c in columns])
            genes = rows["gene"].take(pa.array(np.searchsorted(codes, np.arange(low, low + len(found[0])))))
            yield pa.RecordBatch.from_arrays([genes.combine_chunks(), *map(pa.array, found)], names=["gene", "detected", "coef_d", "p_d", "coef_c", "p_c", "p_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            codes = _numbered(rows)
            # The last gene may go on in the next batch.
            end = int(np.searchsorted(codes, codes[-1]))
            if end:
                yield from fit(rows.slice(0, end), codes[:end])
            rest = rows.slice(end)
        if rest is not None:
            yield from fit(rest, _numbered(rest))

    return run


def _numbered(rows: pa.Table) -> np.ndarray:
    """The genes of rows in order of genes as numbers from 0; null is one of them."""
    return rows["gene"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def covariate_tests(matrix: DataFrame, samples: DataFrame, covariates: list[str], tested: list[str], scratch: Scratch) -> DataFrame:
    """(gene, detected, coef_d, p_d, coef_c, p_c, p_h and the three adjusted) of ``tested`` among ``covariates`` in a two-part model.

    ``matrix``: (sample, gene, value), a value detected where it is positive; ``samples``:
    (sample, covariates), numbers.  Detection is logistic, the level least squares of
    log2 values where detected; each is compared with the model without ``tested`` by
    its likelihood, and both together with the sum of degrees of freedom.  A gene
    enters as counts and sums by covariate pattern, at most as many rows as there are
    patterns; the genes of a batch of rows are fitted together.  The level's figures are null where it has too few values or
    no variance is left.  Coefficients are the first tested covariate's.  Samples with a null covariate are left out; so
    are genes without a detected value.
    """
    known = samples.select("sample", *[F.col(c).cast("double").alias(c) for c in covariates]).dropna()
    design = known.groupBy(*covariates).agg(F.count("*").alias("size")).orderBy(*covariates).limit(MOST_PATTERNS + 1).toPandas()
    if len(design) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} covariate patterns")
    kind = dict(matrix.dtypes)["gene"]
    schema = f"gene {kind}, detected long, coef_d double, p_d double, coef_c double, p_c double, p_h double"
    if not len(design):
        return matrix.sparkSession.createDataFrame([], schema + ", padj_d double, padj_c double, padj_h double")
    numbered = matrix.sparkSession.createDataFrame([(int(k), *map(float, r)) for k, r in enumerate(design[covariates].to_numpy())], "pattern int, " + ", ".join(f"`{c}` double" for c in covariates))
    placed = known.join(F.broadcast(numbered), covariates).select("sample", "pattern")  # the patterns, whose number is checked
    v = F.log2(F.col("value").cast("double"))
    by = matrix.filter("value > 0").join(placed, "sample").groupBy("gene", "pattern").agg(F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    found = by.repartition("gene").sortWithinPartitions("gene").mapInArrow(_tests(design, covariates, tested), schema)
    found = found.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])
    found = scratch.keep(found, "found")
    for part in "dch":
        found = adjusted_over_all(found, f"p_{part}", scratch, f"padj_{part}", f"adjust_{part}")
    return found
