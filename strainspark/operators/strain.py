"""Strain frequencies: likelihoods, deconvolution, summaries and competition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainspark.functions.numeric import log2p1, logit, ratio
from strainspark.operators.ranking import first_of, z_scores
from strainspark.operators.relations import pairs_in_time
from strainspark.scratch import Scratch

#: Sequencing error of the site model and its least probability.
ERROR, LEAST = 0.01, 1e-10


def nucleotide_frequencies(counts: DataFrame) -> DataFrame:
    """Adds ``f``: the error model's frequency of each allele (sample, pos, allele, n)."""
    depth = F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy("sample", "pos")))
    return counts.withColumn("f", F.greatest(F.lit(LEAST), (1 - ERROR) * F.greatest(F.lit(LEAST), F.col("n") / depth) + ERROR / 4))


def site_likelihoods(counts: DataFrame, frequencies: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(sample, pos, model, observed, uniform): log-likelihoods of each site.

    ``frequencies``: (sample, strain, z); ``genotypes``: (strain, pos, allele, p).
    """
    mixed = frequencies.join(genotypes, "strain").groupBy("sample", "pos", "allele").agg(F.sum(F.col("z") * F.col("p")).alias("zp"))
    rows = nucleotide_frequencies(counts).join(mixed, ["sample", "pos", "allele"], "left")
    model = F.greatest(F.lit(LEAST), (1 - ERROR) * F.coalesce("zp", F.lit(0.0)) + ERROR / 4)
    return rows.groupBy("sample", "pos").agg(F.sum(F.col("n") * F.log(model)).alias("model"), F.sum(F.col("n") * F.log("f")).alias("observed"), (F.sum("n") * F.log(F.lit(0.25))).alias("uniform"))


def information_criteria(likelihood: float, samples: int, strains: int, sites: int, reads: float) -> tuple[float, float]:
    """(AIC, BIC) with 1 + M (N - 1) + 3 N L parameters."""
    k = 1 + samples * (strains - 1) + 3 * strains * sites
    return 2 * k - 2 * likelihood, k * float(np.log(reads)) - 2 * likelihood


def sample_frequencies(counts: DataFrame, genotypes: DataFrame, rounds: int = 200) -> DataFrame:
    """(sample, strain, z): each sample's most likely mixture of known genotypes, by expectation maximisation on the simplex.

    Samples are independent given the genotypes: one group each, its rows its
    covered (site, allele, strain) triples.
    """
    rows = counts.join(genotypes, ["pos", "allele"], "inner").select("sample", "pos", "allele", "n", "strain", "p")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        strains = np.sort(pdf["strain"].unique())
        wide = pdf.pivot_table(index=["pos", "allele"], columns="strain", values="p", aggfunc="max", fill_value=0.0)[strains]
        n = pdf.groupby(["pos", "allele"])["n"].first().loc[wide.index].to_numpy(float)
        p = (1 - ERROR) * wide.to_numpy() + ERROR / 4
        z = np.full(len(strains), 1 / len(strains))
        for _ in range(rounds):
            part = p * z
            more = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0)
            following = more / more.sum()
            if np.abs(following - z).max() < 1e-10:
                break
            z = following
        return pd.DataFrame({"sample": pdf["sample"].iat[0], "strain": strains, "z": z})

    kinds = dict(rows.dtypes)
    return rows.groupBy("sample").applyInPandas(fit, f"sample {kinds['sample']}, strain {kinds['strain']}, z double")


def site_genotypes(counts: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(strain, pos, allele, p): for each site the one-hot genotypes of the best likelihood, strain by strain from the most abundant.

    Sites are independent given the frequencies: one group each.
    """
    rows = counts.join(frequencies, "sample")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        alleles = np.sort(pdf["allele"].unique())
        z = pdf.pivot_table(index="sample", columns="strain", values="z", aggfunc="max", fill_value=0.0)
        n = pdf.drop_duplicates(["sample", "allele"]).pivot_table(index="sample", columns="allele", values="n", aggfunc="sum", fill_value=0.0).loc[z.index, alleles].to_numpy(float)
        zs = z.to_numpy()
        order = np.argsort(-zs.sum(axis=0), kind="stable")
        best = n.sum(axis=0).argmax()
        pick = np.full(zs.shape[1], best)
        for _ in range(4):
            before = pick.copy()
            for s in order:
                scores = []
                for a in range(len(alleles)):
                    pick[s] = a
                    share = np.zeros_like(n)
                    for k in range(zs.shape[1]):
                        share[:, pick[k]] += zs[:, k]
                    scores.append((n * np.log(np.maximum(LEAST, (1 - ERROR) * share + ERROR / 4))).sum())
                pick[s] = int(np.argmax(scores))
            if (before == pick).all():
                break
        return pd.DataFrame({"strain": z.columns, "pos": pdf["pos"].iat[0], "allele": alleles[pick], "p": 1.0})

    kinds = dict(rows.dtypes)
    return rows.groupBy("pos").applyInPandas(fit, f"strain {kinds['strain']}, pos {kinds['pos']}, allele string, p double")


def deconvolved(counts: DataFrame, seeds: DataFrame, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frequencies, genotypes) after ``rounds`` of sample and site steps from seed genotypes; each step is a written table."""
    scratch, genotypes = Scratch(counts.sparkSession, "strains"), seeds
    frequencies = scratch.keep(sample_frequencies(counts, genotypes), "z0")
    for k in range(1, rounds + 1):
        genotypes = scratch.keep(site_genotypes(counts, frequencies), f"p{k}")
        frequencies = scratch.keep(sample_frequencies(counts, genotypes), f"z{k}")
    return frequencies, genotypes


def frequency_summary(frequencies: DataFrame, classes: DataFrame, case: str) -> DataFrame:
    """Per strain: mean, means by class, mean below and above one half, prevalence over one half, and shares up to .05, .25, .5 and .95."""
    f = F.col("freq")
    rows = frequencies.join(classes, "sample")
    share = lambda cut: F.avg(F.when(f <= cut, 1.0).otherwise(0.0))
    return rows.groupBy("strain").agg(
        F.count("*").alias("n"), F.avg(f).alias("mean"), F.avg(F.when(F.col("class") == case, f)).alias("mean_case"), F.avg(F.when(F.col("class") != case, f)).alias("mean_control"),
        F.avg(F.when(f <= 0.5, f)).alias("mean_low"), F.avg(F.when(f >= 0.5, f)).alias("mean_high"), F.avg(F.when(f > 0.5, 1.0).otherwise(0.0)).alias("prevalence"),
        *[share(c).alias(f"share_{int(c * 100):02d}") for c in (0.05, 0.25, 0.5, 0.95)])


def strain_features(abundance: DataFrame, frequencies: DataFrame, least: float, cut: float) -> DataFrame:
    """(sample, kind, feature, value): log2(x + 1) of strain and species abundance.

    Strains of frequency ``least`` or less count 0; samples are kept if their
    frequency-weighted abundance sums to ``cut`` or more, at six places, so that
    the order of summation doesn't decide on a sum that is the cut.
    """
    x = abundance.join(frequencies, ["sample", "species"]).withColumn("ab", F.when(F.col("freq") > least, F.col("freq") * F.col("tpk")).otherwise(0.0))
    kept = x.groupBy("sample").agg(F.sum("ab").alias("t")).filter(F.round("t", 6) >= cut).select("sample")
    x = x.join(kept, "sample", "left_semi")
    strains = x.select("sample", F.lit("strain").alias("kind"), F.concat_ws(".", "species", "strain").alias("feature"), "ab")
    species = x.groupBy("sample", "species").agg(F.sum("ab").alias("ab")).select("sample", F.lit("species").alias("kind"), F.col("species").alias("feature"), "ab")
    return strains.union(species).select("sample", "kind", "feature", log2p1(F.col("ab")).alias("value"))


def competition(samples: DataFrame, gap: float = 14.0, least: float = 0.1, fold: float = 1.5) -> DataFrame:
    """Per (name, subject) the pair of samples whose covariate changes most, with the strains' changes.

    ``samples``: (name, subject, day, h, d, c).  Replicates of a day leave the
    largest c.  Pairs need more than ``gap`` days, min(h, d) of the first over
    ``least`` and c changed more than ``fold``.
    """
    rows = samples.withColumn("share", ratio(F.col("h"), F.col("h") + F.col("d")))
    rows = first_of(rows, ["name", "subject", "day"], [F.desc("c"), F.desc("share")])
    rows = z_scores(rows.withColumn("lg", logit(F.col("share"))), ["lg"], ["name", "subject"])
    pairs = pairs_in_time(rows, ["name", "subject"], "day", gap, ["h", "d", "c", "share", "lg_z"])
    good = pairs.filter((F.col("h0") > least) & (F.col("d0") > least) & (F.greatest("c0", "cf") > fold * F.least("c0", "cf")))
    good = good.withColumns({"delta_c": F.col("cf") - F.col("c0"), "delta_share": F.col("sharef") - F.col("share0"), "delta_z": F.col("lg_zf") - F.col("lg_z0")})
    best = first_of(good, ["name", "subject"], [F.desc(F.abs("delta_c")), F.asc("t0"), F.asc("tf")])
    return best.select("name", "subject", "t0", "tf", "delta_c", "delta_share", "delta_z", F.signum("delta_share").cast("int").alias("direction"))


def seed_genotypes(counts: DataFrame) -> DataFrame:
    """(pos, allele): the consensus over samples of each sample's most frequent allele; ties take the first letter."""
    per = Window.partitionBy("sample", "pos").orderBy(F.desc("n"), "allele")
    votes = counts.withColumn("__k", F.row_number().over(per)).filter("__k = 1").groupBy("pos", "allele").agg(F.count("*").alias("votes"))
    return first_of(votes, ["pos"], [F.desc("votes"), F.asc("allele")])


def masked_genotypes(genotypes: DataFrame, frequencies: DataFrame, depths: DataFrame, limit: float) -> DataFrame:
    """(strain, pos, allele, expected): each strain's allele, N where its expected depth over all samples is ``limit`` or less.

    ``genotypes``: (strain, pos, allele); ``frequencies``: (sample, strain, z); ``depths``: (sample, pos, depth).
    """
    expected = frequencies.join(depths, "sample").groupBy("strain", "pos").agg(F.sum(F.col("z") * F.col("depth")).alias("expected"))
    out = genotypes.join(expected, ["strain", "pos"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return out.select("strain", "pos", F.when(F.col("expected") > limit, F.col("allele")).otherwise("N").alias("allele"), "expected")


def genetic_distances(genotypes: DataFrame) -> DataFrame:
    """(a, b, sites, distance): of each two strains the share of common sites, N left out, with unequal alleles; a < b."""
    x = genotypes.filter("allele <> 'N'").select("strain", "pos", "allele")
    a, b = x.select("pos", F.col("strain").alias("a"), F.col("allele").alias("x")), x.select("pos", F.col("strain").alias("b"), F.col("allele").alias("y"))
    return a.join(b, "pos").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("sites"), F.avg((F.col("x") != F.col("y")).cast("int")).alias("distance"))


def frequency_distances(one: DataFrame, other: DataFrame) -> DataFrame:
    """(sample, distance): half the summed differences of two estimates' strain frequencies (sample, strain, z); absent ones are 0."""
    both = one.select("sample", "strain", F.col("z").alias("x")).join(other.select("sample", "strain", F.col("z").alias("y")), ["sample", "strain"], "full")
    return both.groupBy("sample").agg((F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))) / 2).alias("distance"))


def exhaustive_genotypes(counts: DataFrame, frequencies: DataFrame, strains: list) -> DataFrame:
    """(pos, alleles, loglik): for each site the most likely of all combinations of one allele a strain.

    There are as many combinations as alleles to the power of strains, so it is for few strains; they are
    made once and broadcast.  ``counts``: (sample, pos, allele, n); ``frequencies``: (sample, strain, z) of all
    strains.  Of equal likelihoods the first combination in order.
    """
    spark = counts.sparkSession
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    combos = spark.range(1).select(F.explode(letters).alias("s0"))
    for k in range(1, len(strains)):
        combos = combos.withColumn(f"s{k}", F.explode(letters))
    combos = combos.select(F.concat(*[f"s{k}" for k in range(len(strains))]).alias("alleles"))
    wide = frequencies.groupBy("sample").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("strain") == x, F.col("z"))), F.lit(0.0)) for x in strains]).alias("zs"))
    each = counts.filter("n > 0").join(wide, "sample").crossJoin(F.broadcast(combos))
    hit = lambda k: F.when(F.substring("alleles", k + 1, 1) == F.col("allele"), F.col("zs")[k]).otherwise(0.0)
    expected = sum((hit(k) for k in range(1, len(strains))), hit(0))
    model = F.greatest(F.lit(LEAST), (1 - ERROR) * expected + ERROR / 4)
    scored = each.groupBy("pos", "alleles").agg(F.sum(F.col("n") * F.log(model)).alias("loglik"))
    best = first_of(scored.withColumn("__l", F.round("loglik", 6)), ["pos"], [F.desc("__l"), F.asc("alleles")])
    return best.select("pos", "alleles", "loglik")


def converged(likelihoods: list[float], absolute: float, relative: float, rounds: int) -> bool:
    """Whether the last ``rounds`` changes of a likelihood are all below ``absolute``, or below ``relative`` of the value."""
    if len(likelihoods) <= rounds:
        return False
    last = likelihoods[-rounds - 1 :]
    changes = [abs(b - a) for a, b in zip(last, last[1:], strict=False)]
    return all(c < absolute for c in changes) or all(c < relative * max(abs(b), 1e-300) for c, b in zip(changes, last[1:], strict=True))
