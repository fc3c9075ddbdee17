"""Search over many estimates of strain genotypes and frequencies, stepped together as rows of one table.

``sites``: (sample, pos, n), n the counts of A, C, G and T.  An estimate has genotypes
(estimate, pos, g), g the allele of each strain from 0 to 3, and frequencies (estimate,
sample, z), z the strains' shares.  A step works on all estimates at once, by joins on
position and sample; only their likelihoods, one number an estimate, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainspark.operators.strain import ERROR, LEAST
from strainspark.scratch import Scratch

LETTERS = "ACGT"
#: Strains of an estimate, a bit each of a site's pattern.
MOST_STRAINS = 30
#: Numbers of a block of samples that are fitted together.
MOST_NUMBERS = 1 << 19


def site_counts(counts: DataFrame) -> DataFrame:
    """(sample, pos, n) of (sample, pos, allele, n); other letters than A, C, G and T are left out."""
    n = [F.coalesce(F.sum(F.when(F.col("allele") == x, F.col("n"))), F.lit(0)).cast("double") for x in LETTERS]
    return counts.groupBy("sample", "pos").agg(F.array(*n).alias("n")).filter("n[0] + n[1] + n[2] + n[3] > 0")


def first_genotypes(sites: DataFrame, estimates: int, strains: int, seed: str = "1", fixed: DataFrame | None = None) -> DataFrame:
    """(estimate, pos, g): alleles drawn, by a hash of (seed, estimate, strain, pos), as often as all samples show them.

    ``fixed`` (pos, g) gives the alleles of the first strains; the others are drawn.
    """
    pooled = sites.groupBy("pos").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4)])
    below = [sum((F.col(f"n{k}") for k in range(1, j + 1)), F.col("n0")) for j in range(4)]

    def draw(strain: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("estimate").cast("string"), strain.cast("string"), F.col("pos").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
        return F.when(u * below[3] < below[0], 0).when(u * below[3] < below[1], 1).when(u * below[3] < below[2], 2).otherwise(3)

    each = pooled.withColumn("estimate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(estimates - 1).cast("long"))))
    drawn = each.select("estimate", "pos", F.transform(F.sequence(F.lit(0), F.lit(strains - 1)), draw).alias("g"))
    if fixed is None:
        return drawn
    both = drawn.join(fixed.withColumnRenamed("g", "held"), "pos", "left")
    return both.select("estimate", "pos", F.when(F.col("held").isNull(), F.col("g")).otherwise(F.concat("held", F.slice("g", F.size("held") + 1, strains))).alias("g"))


def _expected(g: Column, z: Column, allele: int) -> Column:
    """The error model's share of an allele."""
    hit = F.aggregate(F.zip_with(g, z, lambda a, s: F.when(a == allele, s).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    return F.greatest(F.lit(LEAST), (1 - ERROR) * hit + ERROR / 4)


def site_terms(sites: DataFrame, genotypes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(estimate, sample, pos, model, uniform): log-likelihood of each site under each estimate, and under equal shares."""
    met = sites.join(genotypes, "pos").join(frequencies, ["estimate", "sample"])
    model = sum((F.col("n")[a] * F.log(_expected(F.col("g"), F.col("z"), a)) for a in range(4)), F.lit(0.0))
    uniform = (F.col("n")[0] + F.col("n")[1] + F.col("n")[2] + F.col("n")[3]) * float(np.log(0.25))
    return met.select("estimate", "sample", "pos", model.alias("model"), uniform.alias("uniform"))


def likelihoods(sites: DataFrame, genotypes: DataFrame, frequencies: DataFrame, penalty: float | None = None) -> DataFrame:
    """(estimate, loglik, masked): with ``penalty``, a site whose likelihood is below penalty times that of equal shares is masked and counts as that."""
    terms = site_terms(sites, genotypes, frequencies)
    alone = F.col("model") if penalty is None else F.greatest(F.col("model"), penalty * F.col("uniform"))
    masked = F.lit(False) if penalty is None else F.col("model") < penalty * F.col("uniform")
    return terms.groupBy("estimate").agg(F.sum(alone).alias("loglik"), F.sum(masked.cast("long")).alias("masked"))


def _fitted(bits: np.ndarray, n: np.ndarray, z: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of many samples at once: bits and n are samples by patterns, z samples by strains; a sample stops when it has converged."""
    p = (1 - ERROR) * ((bits[:, :, None] >> np.arange(z.shape[1])) & 1) + ERROR / 4
    out, left = z / z.sum(axis=1, keepdims=True), np.arange(len(z))
    for _ in range(rounds):
        part = p * out[left, None]
        more = (n[:, :, None] * part / part.sum(axis=2, keepdims=True)).sum(axis=1)
        following = more / more.sum(axis=1, keepdims=True)
        moves = np.abs(following - out[left]).max(axis=1) >= 1e-9
        out[left] = following
        if not moves.all():
            left, p, n = left[moves], p[moves], n[moves]
            if not len(left):
                break
    return out


def _mixtures(strains: int, rounds: int):
    @F.pandas_udf("array<double>")
    def fit(bits: pd.Series, n: pd.Series, start: pd.Series) -> pd.Series:
        out: list = [None] * len(bits)
        sizes = bits.map(len).to_numpy()
        order = np.argsort(sizes, kind="stable")
        low = 0
        while low < len(order):
            # Samples of like many patterns are fitted together; fewer patterns are filled with such that no read has.
            wide = np.arange(1, len(order) - low + 1) * sizes[order[low:]] * strains
            here = order[low : low + max(1, int(np.searchsorted(wide, MOST_NUMBERS, side="right")))]
            low += len(here)
            most = int(sizes[here[-1]])
            held, counts, z = np.zeros((len(here), most), np.int64), np.zeros((len(here), most)), np.full((len(here), strains), 1 / strains)
            for k, i in enumerate(here):
                held[k, : sizes[i]], counts[k, : sizes[i]] = bits.iat[i], n.iat[i]
                if start.iat[i] is not None:
                    z[k] = np.maximum(start.iat[i], 1e-9)
            for i, found in zip(here, _fitted(held, counts, z, rounds), strict=True):
                out[i] = found
        return pd.Series(out, dtype=object)

    return fit


def frequency_step(sites: DataFrame, genotypes: DataFrame, strains: int, before: DataFrame | None = None, penalty: float | None = None, rounds: int = 300) -> DataFrame:
    """(estimate, sample, z): each sample's most likely shares given the genotypes, by expectation maximisation.

    A sample's sites enter by which strains hold the allele, so its group is one row a
    pattern, 2 ** strains at most, summed before anything moves.  It starts from
    ``before``, whose masked sites are left out; a sample all of whose sites are masked
    keeps its shares.
    """
    if strains > MOST_STRAINS:
        raise ValueError(f"more than {MOST_STRAINS} strains")
    met = sites.join(genotypes, "pos")
    if penalty is not None and before is not None:
        terms = site_terms(sites, genotypes, before).filter(F.col("model") < penalty * F.col("uniform")).select("estimate", "sample", "pos")
        met = met.join(terms, ["estimate", "sample", "pos"], "left_anti")
    each = met.select("estimate", "sample", "g", F.posexplode("n").alias("allele", "k")).filter("k > 0")
    place = F.expr(f"aggregate(sequence(0, {strains - 1}), 0L, (held, i) -> held + CASE WHEN g[i] = allele THEN shiftleft(1L, i) ELSE 0L END)")
    patterns = each.groupBy("estimate", "sample", place.alias("bits")).agg(F.sum("k").alias("n"))
    gathered = patterns.groupBy("estimate", "sample").agg(F.sort_array(F.collect_list(F.struct("bits", "n"))).alias("patterns"))
    fit = _mixtures(strains, rounds)
    if before is None:
        return gathered.select("estimate", "sample", fit("patterns.bits", "patterns.n", F.lit(None).cast("array<double>")).alias("z"))
    both = before.join(gathered, ["estimate", "sample"], "left")
    return both.filter("patterns IS NOT NULL").select("estimate", "sample", fit("patterns.bits", "patterns.n", "z").alias("z")).union(both.filter("patterns IS NULL").select("estimate", "sample", "z"))


def _pairs(strains: int, held: int) -> list[tuple[int, int, int, int]]:
    """All changes of one or two strains' alleles, as (strain, allele, strain, allele); of one, twice the same."""
    free = range(held, strains)
    return [(i, a, i, a) for i in free for a in range(4)] + [(i, a, j, b) for i in free for j in free if i < j for a in range(4) for b in range(4)]


def _changes(strains: int, held: int, penalty: float | None):
    """Partial sums, by estimate and position, of the likelihood after each change."""
    changes = _pairs(strains, held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        eye = np.eye(4)
        for batch in batches:
            if not len(batch):
                continue
            n, z, g = np.stack(batch["n"].to_numpy()), np.stack(batch["z"].to_numpy()), np.stack(batch["g"].to_numpy()).astype(int)
            own = z[:, :, None] * eye[g]
            share = own.sum(axis=1)
            low = np.full(len(n), -np.inf) if penalty is None else penalty * np.log(0.25) * n.sum(axis=1)
            keys = batch[["estimate", "pos"]].reset_index(drop=True)
            groups = keys.groupby(["estimate", "pos"], sort=False).ngroup().to_numpy()
            sums = np.zeros((groups.max() + 1, len(changes)))
            for c, (i, a, j, b) in enumerate(changes):
                moved = share - own[:, i] + z[:, i, None] * eye[a]
                if i != j:
                    moved = moved - own[:, j] + z[:, j, None] * eye[b]
                model = (n * np.log(np.maximum(LEAST, (1 - ERROR) * moved + ERROR / 4))).sum(axis=1)
                sums[:, c] = np.bincount(groups, np.maximum(model, low), len(sums))
            first = keys.drop_duplicates()
            yield pd.DataFrame({"estimate": np.repeat(first["estimate"].to_numpy(), len(changes)), "pos": np.repeat(first["pos"].to_numpy(), len(changes)), "change": np.tile(np.arange(len(changes)), len(first)), "score": sums.ravel()})

    return run


def genotype_step(sites: DataFrame, genotypes: DataFrame, frequencies: DataFrame, strains: int, held: int = 0, penalty: float | None = None) -> DataFrame:
    """(estimate, pos, g): at each position the change of one or two strains' alleles that raises the likelihood most, if any does.

    All changes are scored in one pass and summed over samples, in the workers' batches
    first.  The first ``held`` strains stay.  Of equal scores the first change.
    """
    kinds, changes = dict(genotypes.dtypes), _pairs(strains, held)
    if not changes:
        return genotypes
    met = sites.join(genotypes, "pos").join(frequencies, ["estimate", "sample"]).select("estimate", "pos", "n", "z", "g")
    scored = met.mapInPandas(_changes(strains, held, penalty), f"estimate long, pos {kinds['pos']}, change int, score double")
    summed = scored.groupBy("estimate", "pos", "change").agg(F.sum("score").alias("score")).join(genotypes, ["estimate", "pos"])
    one = lambda k: F.array(*[F.lit(c[k]) for c in changes])[F.col("change")]
    summed = summed.withColumns({x: one(k) for k, x in enumerate("iajb")})
    cost, same = -F.round("score", 6), F.expr("i = j AND g[i] = a")
    best = summed.groupBy("estimate", "pos").agg(F.min(F.struct(cost.alias("cost"), "change", "i", "a", "j", "b")).alias("best"), F.min(F.when(same, cost)).alias("now"))
    change = best.filter(F.col("best.cost") < F.col("now") - 1e-6).select("estimate", "pos", "best")
    both = genotypes.join(change, ["estimate", "pos"], "left")
    moved = F.transform("g", lambda x, k: F.when(k == F.col("best.i"), F.col("best.a")).when(k == F.col("best.j"), F.col("best.b")).otherwise(x))
    return both.select("estimate", "pos", F.when(F.col("best").isNull(), F.col("g")).otherwise(moved).alias("g"))


def has_converged(history: list[float], rise: float | None, share: float | None, rounds: int) -> bool:
    """Whether the last ``rounds`` values rose by ``rise`` at most, or by ``share`` at most of the rise since the first."""
    if len(history) <= rounds:
        return False
    late, whole = history[-1] - history[-rounds], history[-1] - history[0]
    return (rise is not None and late <= rise) or (share is not None and whole > 0 and late / whole <= share)


class Search:
    """Estimates of ``strains`` strains: ``genotypes``, ``frequencies``, and ``history``, each estimate's log-likelihoods.

    ``step`` moves all estimates that haven't converged by one round of frequencies and
    genotypes; tables are written each round and the former ones dropped.
    """

    def __init__(self, sites: DataFrame, strains: int, scratch: Scratch, penalty: float | None = None, fixed: DataFrame | None = None, held: int = 0):
        self.sites, self.strains, self.scratch, self.penalty, self.fixed, self.held = scratch.keep(sites, "sites"), strains, scratch, penalty, fixed, held
        self.genotypes = self.frequencies = None
        self.history: dict[int, list[float]] = {}
        self._steps = self._made = 0

    def _keep(self, genotypes: DataFrame, frequencies: DataFrame) -> None:
        self._steps += 1
        self.genotypes, self.frequencies = self.scratch.keep(genotypes, f"g{self._steps}"), self.scratch.keep(frequencies, f"z{self._steps}")
        self.scratch.drop(f"g{self._steps - 1}", f"z{self._steps - 1}")

    def _likelihoods(self, ids: list[int] | None = None) -> dict[int, float]:
        some = lambda x: x if ids is None else x.filter(F.col("estimate").isin(ids))
        return {r["estimate"]: r["loglik"] for r in likelihoods(self.sites, some(self.genotypes), some(self.frequencies), self.penalty).collect()}

    def start(self, estimates: int, seed: str = "1") -> list[int]:
        """Adds estimates with drawn genotypes and fitted frequencies; their numbers."""
        new = list(range(self._made, self._made + estimates))
        genotypes = first_genotypes(self.sites, estimates, self.strains, f"{seed}/{self._made}", self.fixed).withColumn("estimate", F.col("estimate") + self._made)
        self._made += estimates
        frequencies = frequency_step(self.sites, genotypes, self.strains)
        if self.genotypes is not None:
            genotypes, frequencies = self.genotypes.unionByName(genotypes), self.frequencies.unionByName(frequencies)
        self._keep(genotypes, frequencies)
        for k, x in self._likelihoods(new).items():
            self.history[k] = [x]
        return new

    def step(self, ids: list[int]) -> None:
        """One round for the given estimates."""
        chosen = F.col("estimate").isin(ids)
        genotypes, frequencies = self.genotypes.filter(chosen), self.frequencies.filter(chosen)
        moved = self.scratch.keep(genotype_step(self.sites, genotypes, frequencies, self.strains, self.held, self.penalty), f"moved{self._steps}")
        fitted = frequency_step(self.sites, moved, self.strains, frequencies, self.penalty)
        self._keep(self.genotypes.filter(~chosen).unionByName(moved), self.frequencies.filter(~chosen).unionByName(fitted))
        for k, x in self._likelihoods(ids).items():
            self.history[k].append(x)

    def run(self, ids: list[int], rounds: int, rise: float | None = 1e-3, share: float | None = None, window: int = 2) -> None:
        """Rounds for the given estimates, each until it has converged or ``rounds`` are done."""
        for _ in range(rounds):
            ids = [k for k in ids if not has_converged(self.history[k], rise, share, window)]
            if not ids:
                return
            self.step(ids)

    def best(self, n: int | None = None) -> list[int]:
        """Numbers of the ``n`` likeliest estimates, the best first."""
        known = [k for k in self.history if self.history[k][-1] == self.history[k][-1]]
        return sorted(known, key=lambda k: (-self.history[k][-1], k))[:n]

    def select(self, n: int) -> list[int]:
        """Keeps the ``n`` likeliest estimates."""
        kept = self.best(n)
        chosen = F.col("estimate").isin(kept)
        self._keep(self.genotypes.filter(chosen), self.frequencies.filter(chosen))
        self.history = {k: self.history[k] for k in kept}
        return kept

    def merge(self, other: Search, n: int) -> list[int]:
        """Takes in another search's estimates, with numbers of their own, and keeps the ``n`` likeliest."""
        shift = self._made
        move = lambda x: x.withColumn("estimate", F.col("estimate") + shift)
        self._keep(self.genotypes.unionByName(move(other.genotypes)), self.frequencies.unionByName(move(other.frequencies)))
        self.history |= {k + shift: list(v) for k, v in other.history.items()}
        self._made += other._made
        return self.select(n)

    def shallow(self, estimates: int, rounds: int, n_keep: int, seed: str = "1", **limits) -> list[int]:
        """Few rounds from many starts; keeps the likeliest."""
        self.run(self.start(estimates, seed), rounds, **limits)
        return self.select(n_keep)

    def deep(self, rounds: int, n_keep: int | None = None, **limits) -> list[int]:
        """Many rounds for those that are kept."""
        self.run(list(self.history), rounds, **limits)
        return self.select(n_keep or len(self.history))

    def table(self) -> DataFrame:
        """(estimate, rounds, loglik, aic, bic) with 1 + M (N - 1) + 3 N L parameters, for M samples, N strains and L sites."""
        size = self.sites.agg(F.countDistinct("sample").alias("m"), F.countDistinct("pos").alias("l"), F.sum(F.expr("n[0] + n[1] + n[2] + n[3]")).alias("reads")).first()
        k = 1 + size["m"] * (self.strains - 1) + 3 * self.strains * size["l"]
        rows = [(i, len(h) - 1, h[-1], 2 * k - 2 * h[-1], k * float(np.log(size["reads"])) - 2 * h[-1]) for i, h in sorted(self.history.items())]
        return self.sites.sparkSession.createDataFrame(rows, "estimate long, rounds long, loglik double, aic double, bic double")


def estimate_distances(genotypes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(a, b, genetic, frequency): of each two estimates, a < b, how far a strain is from the nearest one of the other, on average.

    Genetic: the share of sites with unequal alleles; frequency: one less the cosine of
    the strains' shares over samples.  Of the two directions the larger mean.  Estimates
    are few, the kept ones; strains meet by position and by sample.
    """
    g = genotypes.select("estimate", "pos", F.posexplode("g").alias("strain", "x"))
    z = frequencies.select("estimate", "sample", F.posexplode("z").alias("strain", "x"))

    def paired(rows: DataFrame, on: str, *measures: Column) -> DataFrame:
        one, other = (rows.select(on, F.col("estimate").alias(e), F.col("strain").alias(s), F.col("x").alias(x)) for e, s, x in (("a", "i", "x"), ("b", "j", "y")))
        return one.join(other, on).filter("a < b").groupBy("a", "b", "i", "j").agg(*measures)

    product = lambda x, y: F.sum(F.col(x) * F.col(y))
    genetic = paired(g, "pos", F.avg((F.col("x") != F.col("y")).cast("double")).alias("d"))
    shares = paired(z, "sample", (1 - product("x", "y") / F.greatest(F.sqrt(product("x", "x") * product("y", "y")), F.lit(1e-300))).alias("d"))

    def nearest(pairs: DataFrame, out: str) -> DataFrame:
        mean = [pairs.groupBy("a", "b", side).agg(F.min("d").alias("d")).groupBy("a", "b").agg(F.avg("d").alias("d")) for side in ("i", "j")]
        return mean[0].union(mean[1]).groupBy("a", "b").agg(F.max("d").alias(out))

    return nearest(genetic, "genetic").join(nearest(shares, "frequency"), ["a", "b"])


def agree(distances: DataFrame, genetic: float, frequency: float) -> bool:
    """Whether no two estimates are further apart than both bounds, at least one pair being there."""
    row = distances.agg(F.max("genetic").alias("g"), F.max("frequency").alias("f")).first()
    return row["g"] is not None and row["g"] <= genetic and row["f"] <= frequency
