"""Queries over the synthetic variants, by name, and the DuckDB SQL of those that SQL can express.

Per-group sums are rounded before they are compared, since the two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varfold.functions import special as sp
from varfold.operators import germline as g
from varfold.operators import mixture as m
from varfold.operators.keys import join_on
from varfold.operators.optimality import optimality, slopes
from varfold.operators.prior import default_prior, germline_prior, priors
from varfold.operators.specs import GermlineSpec, SomaticMixtureSpec
from varfold.operators.variants import collected, genotype_class, histogram, is_common, read_germline_variants, weighted_counts
from varfold.sources import vcf
from varfold.sources.arms import CHROMOSOMES, arm_table, reduce_arms, with_arm
from varfold.sources.bgzf import write_blocks
from varfold.sources.shared import SharedTable, shared_path
from varfold.sources.tables import KEYS, VARIANTS_SQL, variants

ARM = ("chrom", "arm")
SPEC, GERMLINE = SomaticMixtureSpec(), GermlineSpec()


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_arm(variants(spark, sf_dir))


def _germline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).where("origin = 'germline'")


def _somatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).where("origin = 'somatic'")


def _round(c: Column | str, digits: int = 4) -> Column:
    """Rounded, and without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


# --- lookups and filters


def arm_table_reduce(spark, sf_dir):
    """Line items looked up in a table of arms that is reduced to centromeres and ends."""
    arms = arm_table(spark)
    found = with_arm(variants(spark, sf_dir), arms).groupBy("chrom").agg(*[F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in ("p", "q")], F.count_if(F.col("arm").isNull()).alias("n_unknown"))
    return join_on(found, reduce_arms(arms), ("chrom",))


def arm_lookup(spark, sf_dir):
    return _arms(spark, sf_dir).groupBy("chrom", "arm").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_GENOTYPES = ("0/1", "1|1", "1/2", "./1", "2/2", "0/0", "1", "./.", "1/1")


def genotype_classes(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    gt = F.get(F.array(*[F.lit(x) for x in _GENOTYPES]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_GENOTYPES)).cast("int"))
    return line.select(gt.alias("gt")).groupBy("gt", genotype_class("gt").alias("genotype")).agg(F.count("*").alias("n"))


_CSQ = "concat('G', cast(l_partkey % 7 as {s}), '|', case when l_linenumber % 2 = 0 then 'HIGH' else 'LOW' end, '|', case l_suppkey % 6 when 0 then '' when 1 then '0.05' when 2 then '0.1&0.2' when 3 then 'NaN' when 4 then '0.051' else '0.3' end, case when l_orderkey % 3 = 0 then ',H|LOW|0.9' else '' end)"


def csq_af_filter(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    made = line.withColumn("csq", F.expr(f"case when l_orderkey % 11 = 0 then null when l_orderkey % 11 = 1 then '' else {_CSQ.format(s='string')} end"))
    keys = vcf.csq_keys('"Consequence annotations. Format: gene|impact| AF"')
    kept = made.where(F.col("csq").isNotNull() & (F.col("csq") != "")).where(is_common(vcf.csq_value("csq", keys, "AF")))
    return kept.groupBy(vcf.csq_value("csq", keys, "gene").alias("gene")).agg(F.count("*").alias("n"))


#: The header of the VCF files that the queries below write and read again.
VCF_HEADER = """##fileformat=VCFv4.2
##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of samples with data">
##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations. Format: gene|impact|AF">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"""


#: Bytes of a block-gzip file that a task reads below, so that the files are read in ranges at every scale.
_RANGE = 1 << 18


def _vcf(spark, sf_dir, packed: bool = False) -> DataFrame:
    """Germline variants of VCF files made from line items in the shared folder: header, records and all; plain or block-gzip."""
    v = variants(spark, sf_dir)
    gt = F.when(F.col("genotype") == "homalt", "1/1").when(F.col("genotype") == "hetalt", "0/1").otherwise("0/0")
    af = F.when(F.col("pos") % 4 == 0, "0.01").otherwise("0.25")
    info = F.concat(F.lit("NS=1;CSQ=G|HIGH|"), af, F.lit(";DB"))
    ref = (F.col("depth") - F.col("alt")).cast("string")
    sample = F.concat_ws(":", gt, F.col("depth").cast("string"), F.concat_ws(",", ref, F.col("alt").cast("string")))
    fields = [F.col("chrom"), F.col("pos").cast("string"), *[F.lit(x) for x in (".", "A", "C", "50", "PASS")], info, F.lit("GT:DP:AD"), sample]
    path = shared_path(spark, "vcf")
    lines = v.select(F.concat_ws("\t", *fields).alias("value"))
    if packed:
        write_blocks(lines, VCF_HEADER, path)
        return read_germline_variants(spark, path, split_bytes=_RANGE)
    vcf.write_vcf(lines, VCF_HEADER, path)
    return read_germline_variants(spark, path)


def vcf_germline(spark, sf_dir, packed: bool = False):
    """Counts and reads of the germline variants in VCF files."""
    return _vcf(spark, sf_dir, packed).groupBy("chrom", "arm", "genotype").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"), F.sum("alt").alias("alt"))


def vcf_block_gzip(spark, sf_dir):
    """The same from block-gzip files, each a whole VCF, of which a task reads a range of blocks."""
    return vcf_germline(spark, sf_dir, packed=True)


# --- germline


def germline_store(spark, sf_dir):
    """The collected store, opened again: counts, reads and fractions of its lists."""
    opened = collected(_vcf(spark, sf_dir)).select("chrom", "arm", "genotype", F.explode("variants").alias("v"))
    return opened.groupBy("chrom", "arm", "genotype").agg(
        F.count("*").alias("n"), F.sum("v.DP").alias("depth"), F.sum("v.alt_DP").alias("alt"), _round(F.sum("v.VAF"), 4).alias("vaf")
    )


def germline_collect_counts(spark, sf_dir):
    v = _germline(spark, sf_dir).where(F.col("genotype").isNotNull())
    return v.groupBy(*KEYS, "genotype").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"), F.sum("alt").alias("alt"))


def _moments(spark, sf_dir) -> DataFrame:
    c = g.counts_by_class(_germline(spark, sf_dir))
    mu, kappa = g.moment_start("mean_het", "var_het", GERMLINE.mu_het_bounds, GERMLINE.kappa_bounds)
    return c.select("*", mu.alias("mu0"), kappa.alias("kappa0"))


def germline_moments(spark, sf_dir):
    c = _moments(spark, sf_dir)
    return c.select(*KEYS, "n_het", "n_hom", *[_round(x, 6).alias(x) for x in ("mean_het", "mean_hom", "var_het", "var_hom", "mu0")], _round("kappa0", 2).alias("kappa0"))


def germline_fallback(spark, sf_dir):
    c = g.counts_by_class(_germline(spark, sf_dir))
    out = []
    for kind in ("het", "hom"):
        mu, kappa = g.fallback(f"n_{kind}", f"mean_{kind}", kind, GERMLINE)
        out += [_round(mu, 6).alias(f"mu_{kind}"), kappa.alias(f"kappa_{kind}")]
    return c.select(*KEYS, *out)


def _moment_fits(spark, sf_dir) -> DataFrame:
    """Moment estimates in the place of fits, for queries that SQL can follow; the mean is rounded so that flags agree."""
    c = _moments(spark, sf_dir).where("n_het > 0")
    zero = F.lit(0.0)
    rows = c.select(*KEYS, F.round("mu0", 6).alias("mu_het"), F.round("kappa0", 2).alias("kappa_het"), zero.alias("loglik_het"), "n_het", zero.alias("loglik_hom"), "n_hom")
    return g.with_flags(rows, GERMLINE)


def germline_flags(spark, sf_dir):
    f = _moment_fits(spark, sf_dir)
    return f.select(*KEYS, "n_variants", _round("allelic_imbalance", 6).alias("allelic_imbalance"), "has_loh_signal", "has_loh_by_spec", _round("confidence", 6).alias("confidence"), "het_direction")


# --- priors


def _flat_prior(df: DataFrame, keys=KEYS) -> DataFrame:
    arrays = [_round(F.get(c, F.lit(k)), d).alias(f"{n}{k}") for c, n, d in (("mu_prior_mean", "mu", 6), ("mu_prior_sigma", "sigma", 6), ("kappa_prior_mean", "kappa", 2), ("pi_prior", "pi", 6)) for k in range(3)]
    return df.select(*keys, *arrays, "kappa_prior_log_sigma", "loh_detected", _round("confidence", 6).alias("confidence"), "source")


def somatic_prior(spark, sf_dir):
    every = _arms(spark, sf_dir).select(*KEYS).distinct()
    return _flat_prior(priors(every, _moment_fits(spark, sf_dir), tumor_purity=0.8))


def default_priors(spark, sf_dir):
    """The prior of each arm where no germline estimate is given."""
    return _flat_prior(priors(_arms(spark, sf_dir).select(*ARM).distinct(), None, ARM), ARM)


# --- mixture


def smart_init(spark, sf_dir):
    return m.smart_init(_somatic(spark, sf_dir)).select(*KEYS, *[_round(F.get("init_mu", F.lit(k)), 6).alias(f"mu{k}") for k in range(3)])


def bb_logpmf_by_arm(spark, sf_dir):
    """Log-likelihood of each arm under one law, over counts: distinct (alt, depth) are few, whatever the rows."""
    scored = sp.with_logpmf(histogram(_arms(spark, sf_dir), ARM), {"logpmf": (F.lit(0.5), F.lit(50.0))})
    return scored.groupBy(*ARM).agg(_round(F.sum(F.col("weight") * F.col("logpmf")), 3).alias("loglik"), F.sum("weight").alias("n"))


def _with_default(df: DataFrame) -> DataFrame:
    total = sum(SPEC.pi_prior_default)
    return df.select("*", F.array(*sp.literals(SPEC.mu_default)).alias("mu"), F.array(*sp.literals(SPEC.kappa_default)).alias("kappa"), F.array(*sp.literals([x / total for x in SPEC.pi_prior_default])).alias("pi"))


def _scored_counts(spark, sf_dir, keys=KEYS) -> DataFrame:
    """One E-step from the default prior over counts, not rows: the likelihood depends on a row through (alt, depth) only."""
    return m.e_step(_with_default(histogram(_somatic(spark, sf_dir), keys)))


def estep_loglik(spark, sf_dir):
    s = _scored_counts(spark, sf_dir).groupBy(*KEYS).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("log_norm")).alias("ll"))
    return s.select(*KEYS, "n", _round("ll", 3).alias("loglik"), _round(-2.0 * F.col("ll") + m.PARAMETERS * F.ln(F.col("n").cast("double")), 2).alias("bic"))


def em_pi_update(spark, sf_dir):
    mass = [F.sum(F.col("weight") * F.get("resp", F.lit(k))) + SPEC.pi_prior_default[k] for k in range(3)]
    s = _scored_counts(spark, sf_dir).groupBy(*KEYS).agg(*[x.alias(f"e{k}") for k, x in enumerate(mass)])
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return s.select(*KEYS, *[_round(F.col(f"e{k}") / total, 6).alias(f"pi{k}") for k in range(3)])


def predict_labels(spark, sf_dir):
    s = _scored_counts(spark, sf_dir, ARM).select(*ARM, "weight", sp.label("resp").alias("label"), sp.label("resp", 0.9).alias("sure_label"))
    return s.groupBy(*ARM, "label", "sure_label").agg(F.sum("weight").alias("n"))


def _predicted_by_default(spark, sf_dir, threshold: float) -> DataFrame:
    """Counts by arm with their labels; scoring counts instead of rows keeps this work the same whatever the rows."""
    somatic = _somatic(spark, sf_dir)
    return m.predict(weighted_counts(somatic, ARM), _with_default(somatic.select(*ARM).distinct()), ARM, threshold)


def posteriors_by_name(spark, sf_dir):
    """Rows by chromosome and the name of their likeliest component, from array functions: log-likelihoods and posteriors.

    Counts are scored, not rows: distinct (alt, depth) are few, whatever the rows.
    """
    laws = [(*sp.shapes(m_, c), p / sum(SPEC.pi_prior_default)) for m_, c, p in zip(SPEC.mu_default, SPEC.kappa_default, SPEC.pi_prior_default, strict=True)]
    joint = F.array(*[F.ln(F.lit(p + sp.PI_FLOOR)) + sp.beta_binom_logpmf("alt", "depth", a, b) for a, b, p in laws])
    rows = sp.staged(weighted_counts(_somatic(spark, sf_dir), ("chrom",)), joint=joint)
    rows = sp.staged(rows, log_norm=sp.logsumexp("joint"))
    rows = sp.staged(rows, resp=sp.softmax("joint", "log_norm"))
    own, w = F.get("resp", sp.argmax("resp")), F.col("weight")
    return rows.groupBy("chrom", sp.component_name(sp.argmax("resp")).alias("component")).agg(F.sum(w).alias("n"), _round(F.sum(w * F.col("log_norm")), 3).alias("loglik"), _round(F.sum(w * own), 4).alias("certainty"))


def component_rows(spark, sf_dir):
    """Rows of each component by arm, however uncertain: what is filtered is a computed value, not its expression."""
    scored = _predicted_by_default(spark, sf_dir, 0.0)
    parts = [m.component_rows(scored, k).groupBy(*ARM).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("alt")).alias("alt")).withColumn("component", F.lit(k)) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def uncertain_labels(spark, sf_dir):
    """Rows that no component has at 0.9, by arm, and those among them that the middle one has above one half."""
    unsure = _predicted_by_default(spark, sf_dir, 0.9).where("label = -1")
    w = F.col("weight")
    middle = F.coalesce(F.sum(F.when(F.get("resp", F.lit(1)) > 0.5, w)), F.lit(0))
    return unsure.groupBy(*ARM).agg(F.sum(w).alias("n"), F.sum(w * F.col("depth")).alias("depth"), middle.alias("n_middle"))


def component_summary(spark, sf_dir):
    somatic = _somatic(spark, sf_dir)
    scored = m.e_step(_with_default(weighted_counts(somatic, ARM)))
    fits = _with_default(somatic.select(*ARM).distinct())
    out = m.component_summary(scored, fits, ARM, "weight")
    return out.select(*ARM, "component", "mu", "kappa", "pi", "n_assigned", _round("mean_responsibility", 6).alias("mean_responsibility"))


# --- grids


_MU_GRID, _KAPPA_GRID = (0.10, 0.90, 17), (5.0, 1000.0, 9)


def germline_grid_mle(spark, sf_dir):
    """The best point of a grid over mean and precision for each chromosome.

    A log-likelihood is a sum over alt, over depth - alt and over depth alone, so three marginal counts replace the
    rows, and what doesn't depend on the point is left out until the end.
    """
    v = _germline(spark, sf_dir).where("genotype = 'hetalt'")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), x.cast("double").alias("x")) for i, x in enumerate((F.col("alt"), F.col("depth") - F.col("alt"), F.col("depth")))])
    margins = v.select("chrom", F.explode(sides).alias("s")).groupBy("chrom", "s.side", "s.x").agg(F.count("*").alias("w"))
    (mu_low, mu_high, n_mu), (kappa_low, kappa_high, n_kappa) = _MU_GRID, _KAPPA_GRID
    point = F.explode(F.sequence(F.lit(0), F.lit(n_mu * n_kappa - 1))).alias("point")
    mu_i, kappa_i = F.floor(F.col("point") / n_kappa).cast("int"), (F.col("point") % n_kappa).cast("int")
    mu = mu_low + (mu_high - mu_low) * (mu_i / float(n_mu - 1))
    kappa = kappa_low * F.pow(F.lit(kappa_high / kappa_low), kappa_i / float(n_kappa - 1))
    a, b = sp.shapes(mu, kappa)
    shape = F.when(F.col("side") == 0, a).when(F.col("side") == 1, b).otherwise(a + b)
    sign = F.when(F.col("side") == 2, -1.0).otherwise(1.0)
    sums = margins.select("*", point).groupBy("chrom", "point").agg(
        F.sum(F.col("w") * sign * sp.lgamma(F.col("x") + shape)).alias("s"), F.sum(F.when(F.col("side") == 2, F.col("w"))).alias("n")
    )
    choose = v.groupBy("chrom").agg(F.sum(sp.ln_choose(F.col("depth").cast("double"), F.col("alt").cast("double"))).alias("c"))
    ll = F.col("s") - F.col("n") * sp.ln_beta(a, b)
    scored = sums.join(choose, "chrom").select("chrom", mu_i.alias("mu_i"), kappa_i.alias("kappa_i"), F.round(ll + F.col("c"), 4).alias("loglik"))
    best = scored.groupBy("chrom").agg(F.max(F.struct("loglik", (-F.col("mu_i")).alias("m"), (-F.col("kappa_i")).alias("k"))).alias("b"))
    return best.select("chrom", (-F.col("b.m")).alias("mu_i"), (-F.col("b.k")).alias("kappa_i"), (F.col("b.loglik") + 0.0).alias("loglik"))


def _component_masses(spark, sf_dir) -> DataFrame:
    """(chrom, k, alt, depth, mass): responsibilities after one E-step, one row a component."""
    s = _scored_counts(spark, sf_dir, ("chrom",))
    # Exploding the posteriors themselves would have their whole expression pushed down as a filter; a literal range has none.
    rows = s.select("chrom", "alt", "depth", "weight", "resp", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return rows.select("chrom", "k", "alt", "depth", (F.col("weight") * F.get("resp", F.col("k"))).alias("mass"))


def _map_step(spark, sf_dir, name: str, mu: Column, kappa: Column, penalty: Column) -> DataFrame:
    """The best of 11 values (number i) of a parameter of each component k, with the log-prior -penalty / 2."""
    own = _component_masses(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    own = sp.with_logpmf(own.withColumn("penalty", penalty), {"logpmf": (mu, kappa)})
    s = own.groupBy("chrom", "k", "i").agg(F.sum(F.col("mass") * F.col("logpmf")).alias("data"), F.max("penalty").alias("penalty"))
    scored = s.select("chrom", "k", "i", F.round(F.col("data") - 0.5 * F.col("penalty"), 3).alias("objective"))
    best = scored.groupBy("chrom", "k").agg(F.max(F.struct("objective", (-F.col("i")).alias("i"))).alias("b"))
    return best.select("chrom", F.col("k").alias("component"), (-F.col("b.i")).alias(f"{name}_i"), (F.col("b.objective") + 0.0).alias("objective"))


def _of_component(values) -> Column:
    return F.get(F.array(*sp.literals(values)), F.col("k"))


def em_mu_grid_step(spark, sf_dir):
    low, high = (_of_component([b[i] for b in SPEC.bounds_mu]) for i in (0, 1))
    mu = low + (high - low) * F.col("i") / 10.0
    z = (mu - _of_component(SPEC.mu_default)) / _of_component(SPEC.mu_prior_sigma_default)
    return _map_step(spark, sf_dir, "mu", mu, F.lit(50.0), z * z)


def em_kappa_grid_step(spark, sf_dir):
    kappa = 5.0 * F.pow(F.lit(100.0), F.col("i") / 10.0)
    z = F.ln(kappa / 50.0) / SPEC.kappa_prior_log_sigma_default
    return _map_step(spark, sf_dir, "kappa", _of_component(SPEC.mu_default), kappa, z * z)


#: Parameters at which slopes are taken: off the prior's means and precisions.
_OFF_MU, _OFF_KAPPA = (0.17, 0.48, 0.82), (40.0, 60.0, 45.0)


def em_slopes(spark, sf_dir):
    """Slopes of the objective by each mean and log-precision of each chromosome, away from an optimum."""
    prior = [c.alias(n) for n, c in default_prior().items() if n in m.NEEDED]
    counts = _with_default(histogram(_somatic(spark, sf_dir), ("chrom",))).select("*", *prior)
    found = slopes(counts.withColumns({"mu": F.array(*sp.literals(_OFF_MU)), "kappa": F.array(*sp.literals(_OFF_KAPPA))}), ("chrom",))
    rows = F.array(*[F.struct(F.lit(k).alias("component"), *[_round(F.get(f"{n}_slopes", F.lit(k)), 4).alias(f"{n}_slope") for n in ("mu", "kappa")]) for k in range(3)])
    return found.select("chrom", F.explode(rows).alias("r")).select("chrom", "r.*")


#: Start means of two further restarts for the query below, beside the default.
_RESTARTS = ((0.15, 0.50, 0.85), (0.19, 0.49, 0.90), (0.12, 0.54, 0.79))


def best_restart(spark, sf_dir):
    """The restart whose start values give the largest log-likelihood; the first of equals."""
    hist = _with_default(histogram(_somatic(spark, sf_dir), KEYS)).drop("mu")
    tries = F.array(*[F.struct(F.lit(i).alias("restart"), F.array(*sp.literals(mu)).alias("mu")) for i, mu in enumerate(_RESTARTS)])
    s = m.e_step(hist.select("*", F.explode(tries).alias("t")).select("*", "t.*").drop("t"))
    ll = s.groupBy(*KEYS, "restart").agg(F.round(F.sum(F.col("weight") * F.col("log_norm")), 4).alias("ll"))
    best = ll.groupBy(*KEYS).agg(F.max(F.struct("ll", (-F.col("restart")).alias("r"))).alias("b"))
    return best.select(*KEYS, (-F.col("b.r")).alias("restart"), (F.col("b.ll") + 0.0).alias("loglik"))


# --- fits (iterative estimators: SQL follows properties of what they find)


#: Steps of the mean and factors of the precision around a germline fit; the first point is the fit.
_AROUND = [(0.0, 1.0)] + [(d, f) for d in (-0.02, -0.002, 0.002, 0.02) for f in (0.8, 1.0, 1.25)]


def _around(counts: DataFrame, fits: DataFrame, kind: str, bounds: tuple[float, float]) -> DataFrame:
    """chrom, own and best: log-likelihoods of ``counts`` under its chromosome's fit, and under the likeliest point around it."""
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(f).alias("f")) for i, (d, f) in enumerate(_AROUND)]))
    rows = join_on(counts, fits.select("chrom", F.col(f"mu_{kind}").alias("mu"), F.col(f"kappa_{kind}").alias("kappa")), ("chrom",), "inner").select("*", points.alias("p"))
    law = (sp.clip(F.col("mu") + F.col("p.d"), *bounds), sp.clip(F.col("kappa") * F.col("p.f"), *GERMLINE.kappa_bounds))
    sums = sp.with_logpmf(rows.select("*", "p.i"), {"logpmf": law}).groupBy("chrom", "i").agg(F.sum(F.col("weight") * F.col("logpmf")).alias("ll"))
    return sums.groupBy("chrom").agg(F.max(F.when(F.col("i") == 0, F.col("ll"))).alias(f"own_{kind}"), F.max("ll").alias(f"best_{kind}"))


def germline_fit_checked(spark, sf_dir):
    """Properties of the germline fits by chromosome: the log-likelihood is that of the rows, and no point around is likelier.

    The fits by genotype column and by a boolean mask are one, and the het fit alone is the same as beside the hom one.
    """
    v, key = _germline(spark, sf_dir), ("chrom",)
    fits = SharedTable(g.fit_germline(v, key), "germline").df
    masked = SharedTable(g.fit_germline_from_mask(v.withColumn("is_het", F.col("genotype") == "hetalt"), keys=key), "germline").df
    alone = SharedTable(g.fit_germline(v.where("genotype = 'hetalt'"), key), "germline").df
    out = fits
    for kind, genotype, bounds in (("het", "hetalt", GERMLINE.mu_het_bounds), ("hom", "homalt", GERMLINE.mu_hom_bounds)):
        out = join_on(out, _around(histogram(v.where(F.col("genotype") == genotype), key), fits, kind, bounds), key)
    out = join_on(out, masked.select(*key, F.struct("mu_het", "kappa_het", "mu_hom", "kappa_hom").alias("masked")), key)
    out = join_on(out, alone.select(*key, F.struct("mu_het", "kappa_het").alias("alone")), key)
    slack = {kind: 1e-6 * (1.0 + F.abs(F.col(f"own_{kind}"))) for kind in ("het", "hom")}
    few = {"het": F.col("n_het") < GERMLINE.min_variants_het, "hom": F.col("n_hom") < GERMLINE.min_variants_hom}
    of_rows = [F.when(few[k], F.col(f"loglik_{k}") == 0.0).otherwise(F.abs(F.col(f"loglik_{k}") - F.col(f"own_{k}")) < slack[k]) for k in slack]
    likeliest = [few[k] | (F.col(f"best_{k}") <= F.col(f"own_{k}") + slack[k]) for k in slack]
    return out.select(
        *key,
        "n_het",
        "n_hom",
        (of_rows[0] & of_rows[1]).alias("loglik_is_of_rows"),
        (likeliest[0] & likeliest[1]).alias("likeliest_around"),
        (F.abs(F.col("loglik") - sum((F.when(few[k], 0.0).otherwise(F.col(f"own_{k}")) for k in slack), F.lit(0.0))) < 2e-6 * (1.0 + F.abs(F.col("loglik")))).alias("total_is_of_rows"),
        (F.col("masked") == F.struct("mu_het", "kappa_het", "mu_hom", "kappa_hom")).alias("mask_is_same"),
        (F.col("alone") == F.struct("mu_het", "kappa_het")).alias("het_alone_is_same"),
    )


#: Chromosomes that lose all but two somatic variants below, and those that lose all.
_TWO_LEFT, _NONE_LEFT = ("chr3", "chr14"), ("chr5", "chrUn")


def mixture_fit_checked(spark, sf_dir):
    """Properties of the mixture fits by chromosome, of which some have two variants or none.

    Sums, bounds and BIC hold; the log-likelihood is that of the rows; the posterior density is not below that of the
    prior's own parameters, and no point around a fit has a larger one; without enough variants the values are the prior's.
    """
    somatic = _somatic(spark, sf_dir)
    order = Window.partitionBy("chrom").orderBy("l_orderkey", "l_linenumber")
    few = somatic.where(F.col("chrom").isin(*_TWO_LEFT)).withColumn("at", F.row_number().over(order)).where("at <= 2").drop("at")
    kept = somatic.where(~F.col("chrom").isin(*_TWO_LEFT, *_NONE_LEFT)).unionByName(few)
    fits = SharedTable(m.fit_mixture(kept, priors(somatic.select("chrom").distinct(), None, ("chrom",)), ("chrom",)), "mixture").df
    counts = histogram(kept, ("chrom",))
    default = _with_default(fits.select("chrom")).select("chrom", *[F.col(c).alias(f"{c}0") for c in ("mu", "kappa", "pi")])
    scored = m.e_step(join_on(counts, fits.select("chrom", "mu", "kappa", "pi"), ("chrom",), "inner")).groupBy("chrom").agg(F.sum(F.col("weight") * F.col("log_norm")).alias("own"))
    start = m.e_step(join_on(counts, default, ("chrom",), "inner"), "mu0", "kappa0", "pi0").groupBy("chrom").agg(F.sum(F.col("weight") * F.col("log_norm")).alias("start"))
    out = join_on(join_on(join_on(fits, scored, ("chrom",)), start, ("chrom",)), optimality(kept, fits, ("chrom",)).select("chrom", "is_optimum"), ("chrom",))
    mu, kappa, pi = (sp.three(c) for c in ("mu", "kappa", "pi"))
    total = sum(SPEC.pi_prior_default)
    penalty = sum((((a - x) / s) * ((a - x) / s) for a, x, s in zip(mu, SPEC.mu_default, SPEC.mu_prior_sigma_default, strict=True)), F.lit(0.0)) + sum(
        ((F.ln(c / x) / SPEC.kappa_prior_log_sigma_default) * (F.ln(c / x) / SPEC.kappa_prior_log_sigma_default) for c, x in zip(kappa, SPEC.kappa_default, strict=True)), F.lit(0.0)
    )
    weighed = sum((w * (F.ln(p + sp.PI_FLOOR) - float(np.log(w / total + sp.PI_FLOOR))) for p, w in zip(pi, SPEC.pi_prior_default, strict=True)), F.lit(0.0))
    fitted, n = F.col("n_variants") >= 3, F.col("n_variants")
    inside = F.lit(True)
    for a, (low, high) in zip(mu, SPEC.bounds_mu, strict=True):
        inside = inside & (a >= low) & (a <= high)
    at_prior = (F.array(*mu) == F.array(*sp.literals(SPEC.mu_default))) & (F.array(*kappa) == F.array(*sp.literals(SPEC.kappa_default))) & F.col("converged") & (F.col("n_iterations") == 0)
    close = lambda x, y: F.abs(x - y) < 1e-6 * (1.0 + F.abs(y))
    return out.select(
        "chrom", n,
        F.when(fitted, "fit").when(n == 0, "no variants").otherwise("too few").alias("kind"),
        F.when(fitted, close(F.col("loglik"), F.col("own"))).otherwise(F.col("loglik") == F.when(n == 0, 0.0).otherwise(float("-inf"))).alias("loglik_holds"),
        F.when(fitted, close(F.col("bic"), m.PARAMETERS * F.ln(n.cast("double")) - 2.0 * F.col("loglik"))).otherwise(F.col("bic") == F.when(n == 0, 0.0).otherwise(float("inf"))).alias("bic_holds"),
        (F.abs(pi[0] + pi[1] + pi[2] - 1.0) < 1e-9).alias("pi_holds"),
        F.when(fitted, inside & (F.col("n_iterations") > 0)).otherwise(at_prior).alias("values_hold"),
        F.when(fitted, F.col("own") - 0.5 * penalty + weighed >= F.col("start") - 1e-6 * F.abs(F.col("start"))).otherwise(True).alias("no_worse_than_prior"),
        F.when(fitted, F.col("is_optimum")).otherwise(True).alias("optimum"),
    )


def arms_checked(spark, sf_dir):
    """Properties of the whole pipeline by arm: variants, where the prior comes from, whether the germline fit stands beside it,
    and whether no point around the fit has a larger posterior density under that prior."""
    somatic = _somatic(spark, sf_dir)
    fits = SharedTable(m.fit_arms(_germline(spark, sf_dir), somatic, KEYS), "arms").df
    out = join_on(fits, optimality(somatic, fits, KEYS).select(*KEYS, "is_optimum"), KEYS)
    own = F.col("germline_fit")
    return out.select(*KEYS, "n_variants", "prior_source", own["n_het"].alias("n_het"), (own.isNull() == (F.col("prior_source") == "default")).alias("fit_beside_prior"), (F.size("mu") == 3).alias("whole"), F.when(F.col("n_variants") >= 3, F.col("is_optimum")).otherwise(True).alias("optimum"))


def germline_mle(spark, sf_dir):
    return g.fit_germline(_germline(spark, sf_dir), ARM)


def somatic_mixture(spark, sf_dir):
    somatic = _somatic(spark, sf_dir)
    prior = priors(somatic.select(*ARM).distinct(), None, ARM)
    return m.fit_mixture(somatic, prior, ARM)


def fit_arm(spark, sf_dir):
    """Every chromosome arm over all samples."""
    return m.fit_arms(_germline(spark, sf_dir), _somatic(spark, sf_dir), ARM)


def fit_sample_arm(spark, sf_dir):
    """Every chromosome arm of every sample."""
    return m.fit_arms(_germline(spark, sf_dir), _somatic(spark, sf_dir), KEYS)


def predicted(spark, sf_dir):
    """Label counts under the fitted mixtures."""
    somatic = _somatic(spark, sf_dir)
    fits = m.fit_mixture(somatic, priors(somatic.select(*ARM).distinct(), None, ARM), ARM)
    return m.predict(weighted_counts(somatic, ARM), fits, ARM, 0.5).groupBy(*ARM, "label").agg(F.sum("weight").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        arm_table_reduce,
        arm_lookup,
        genotype_classes,
        csq_af_filter,
        vcf_germline,
        vcf_block_gzip,
        germline_collect_counts,
        germline_moments,
        germline_fallback,
        germline_flags,
        somatic_prior,
        default_priors,
        smart_init,
        bb_logpmf_by_arm,
        germline_store,
        posteriors_by_name,
        component_rows,
        uncertain_labels,
        germline_fit_checked,
        mixture_fit_checked,
        arms_checked,
        estep_loglik,
        em_pi_update,
        predict_labels,
        component_summary,
        germline_grid_mle,
        em_mu_grid_step,
        em_kappa_grid_step,
        em_slopes,
        best_restart,
        germline_mle,
        somatic_mixture,
        fit_arm,
        fit_sample_arm,
        predicted,
    )
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_arm(spark, sf_dir)


# --- SQL

_CENT = "cent(chrom, centromere) as (values " + ", ".join(f"('{c}', {p})" for c, p, _ in CHROMOSOMES) + ")"
_V = f"with {VARIANTS_SQL}, {_CENT}, v as (select r.*, cast(floor(depth*vaf_pct/100.0) as int) as alt, case when c.centromere is null then null when pos < c.centromere then 'p' else 'q' end as arm from raw r left join cent c using (chrom)), ger as (select *, alt/(depth+1e-9) as vaf from v where origin='germline'), som as (select *, alt/(depth+1e-9) as vaf from v where origin='somatic')"
_K = "sample_id, chrom, arm"
_SUMS = f"""mom as (select {_K}, count(*) filter (genotype='hetalt') as n_het, count(*) filter (genotype='homalt') as n_hom,
  avg(vaf) filter (genotype='hetalt') as mean_het, avg(vaf) filter (genotype='homalt') as mean_hom,
  var_pop(vaf) filter (genotype='hetalt') as var_het, var_pop(vaf) filter (genotype='homalt') as var_hom from ger group by all),
mk as (select *, greatest(11e-2, least(89e-2, mean_het)) as mu0 from mom),
mm as (select *, case when var_het>0 and var_het<mu0*(1-mu0) then greatest(5e0, least(1e3, mu0*(1-mu0)/var_het-1)) else 5e1 end as kappa0 from mk)"""
_FLAGS = """fl as (select sample_id, chrom, arm, n_het, n_hom, round(mu0,6) as mu_het, round(kappa0,2) as kappa_het, abs(round(mu0,6)-5e-1) as imb,
  greatest(1e-1, least(1e0, n_het/3e1)) as confidence from mm where n_het>0)"""
_LB = "(lgamma({a})+lgamma({b})-lgamma(({a})+({b})))"
_CH = "(lgamma(depth+1e0)-lgamma(alt+1e0)-lgamma(depth-alt+1e0))"


def _pmf(a: str, b: str) -> str:
    return f"({_CH}+lgamma(alt+{a})+lgamma(depth-alt+{b})-lgamma(depth+{a}+{b})-{_LB.format(a=a, b=b)})"


def _joint(mu, kappa, pi, k: int) -> str:
    return f"(ln({pi[k]!r}+1e-10)+{_pmf(repr(float(mu[k] * kappa[k])), repr(float((1 - mu[k]) * kappa[k])))})"


def _estep(mu=SPEC.mu_default, keys: str = _K, kappa=SPEC.kappa_default) -> str:
    pi = [x / sum(SPEC.pi_prior_default) for x in SPEC.pi_prior_default]
    j = [f"cast({_joint(mu, kappa, pi, k)} as double) as j{k}" for k in range(3)]
    return f"""es as (select *, greatest(j0,j1,j2) as jm from (select {keys}, alt, depth, {', '.join(j)} from som)),
ln_ as (select *, jm+ln(exp(j0-jm)+exp(j1-jm)+exp(j2-jm)) as lse from es),
rs as (select *, exp(j0-lse) as r0, exp(j1-lse) as r1, exp(j2-lse) as r2 from ln_)"""


_LABEL = "case when r0>=r1 and r0>=r2 then 0 when r1>=r2 then 1 else 2 end"


def _case(values) -> str:
    return "case k " + " ".join(f"when {k} then {float(v)!r}" for k, v in enumerate(values[:2])) + f" else {float(values[2])!r} end"


def _map_sql(name: str, mu: str, kappa: str, penalty: str) -> str:
    pmf = _pmf("a", "b")
    return f"""{_V}, {_estep(keys="chrom")}, mass as (select chrom, 0 as k, alt, depth, r0 as w from rs union all select chrom, 1, alt, depth, r1 from rs union all select chrom, 2, alt, depth, r2 from rs),
hist as (select chrom, k, alt, depth, sum(w) as w from mass group by all),
grid as (select k, i, {mu} as mu, {kappa} as kappa from (select unnest(range(3)) as k) a, (select unnest(range(11)) as i) c),
ab as (select k, i, mu*kappa as a, (1-mu)*kappa as b, {penalty} as pen from grid),
sc as (select chrom, k, i, round(sum(w*{pmf})-5e-1*max(pen), 3) as o from hist join ab using (k) group by chrom, k, i),
bs as (select *, row_number() over (partition by chrom, k order by o desc, i) as rn from sc)
select chrom, cast(k as int) as component, cast(i as int) as {name}_i, o+0e0 as objective from bs where rn=1"""


def _psi(x: str) -> str:
    """Digamma by its series, since the engine has none."""
    z = f"({x}+8e0)"
    series = "".join(f"{'-' if c > 0 else '+'}{abs(c)!r}*pow({z},-{2 * i + 2})" for i, c in enumerate((1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)))
    return f"(ln{z}-5e-1/{z}{series}-(" + "+".join(f"1e0/({x}+{i}e0)" for i in range(8)) + "))"


def _slopes_sql(k: int) -> str:
    mu, kappa, mu0, sigma, spread = _OFF_MU[k], _OFF_KAPPA[k], SPEC.mu_default[k], SPEC.mu_prior_sigma_default[k], SPEC.kappa_prior_log_sigma_default
    a, b = repr(mu * kappa), repr((1 - mu) * kappa)
    one, two, three = f"sum(r{k}*({_psi(f'(alt+{a})')}-{_psi(a)}))", f"sum(r{k}*({_psi(f'(depth-alt+{b})')}-{_psi(b)}))", f"sum(r{k}*({_psi(repr(kappa))}-{_psi(f'(depth+{kappa!r})')}))"
    return f"""select chrom, cast({k} as int) as component, round({kappa!r}*(cast({one} as double)-cast({two} as double))-({(mu - mu0) / sigma**2!r}),4)+0e0 as mu_slope,
  round({kappa!r}*({mu!r}*cast({one} as double)+{1 - mu!r}*cast({two} as double)+cast({three} as double))-({float(np.log(kappa / 50.0)) / spread**2!r}),4)+0e0 as kappa_slope from rs group by chrom"""


_PRIOR_COLUMNS = ", ".join(f"round({e}, {d})+0e0 as {n}" for n, e, d in [
    ("mu0", "case when s then 12e-2 else 15e-2 end", 6),
    ("mu1", "case when not s then 5e-1 when loh then mu_het else 5e-1 end", 6),
    ("mu2", "case when s and loh then greatest(6e-1, least(95e-2, case when mu_het>5e-1 then mu_het else 1-mu_het end)) else 85e-2 end", 6),
    ("sigma0", "case when s then 8e-2*sc else 8e-2 end", 6),
    ("sigma1", "case when s then (case when loh then 5e-2 else 1e-1 end)*sc else 12e-2 end", 6),
    ("sigma2", "case when s then (case when loh then 8e-2 else 12e-2 end)*sc else 12e-2 end", 6),
    *[(f"kappa{k}", "case when s then kappa_het else 5e1 end", 2) for k in range(3)],
    ("pi0", "case when s then (case when loh then 1e0 else 2e0 end)*(1+confidence) else 2e0 end", 6),
    ("pi1", "case when s then (case when loh then 3e0 else 4e0 end)*(1+confidence) else 4e0 end", 6),
    ("pi2", "case when s then (case when loh then 3e0 else 15e-1 end)*(1+confidence) else 2e0 end", 6),
])

ORACLE_SQL: dict[str, str] = {
    "arm_table_reduce": f"{_V}, ends(chrom, chr_end) as (values "
    + ", ".join(f"('{c}', {e})" for c, _, e in CHROMOSOMES)
    + ") select v.chrom, count(*) filter (arm='p') as n_p, count(*) filter (arm='q') as n_q, count(*) filter (arm is null) as n_unknown, cast(max(c.centromere) as bigint) as centromere, cast(max(e.chr_end) as bigint) as chr_end"
    " from v left join cent c on v.chrom=c.chrom left join ends e on v.chrom=e.chrom group by v.chrom",
    "arm_lookup": f"{_V} select chrom, arm, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from v group by chrom, arm",
    "genotype_classes": "with x as (select list_extract([" + ", ".join(f"'{x}'" for x in _GENOTYPES) + "], cast((l_partkey+l_linenumber)%9 as int)+1) as gt from lineitem), y as (select gt, string_split(replace(gt,'|','/'),'/') as a from x)"
    " select gt, case when len(a)<>2 then 'skip' when a[1]='1' and a[2]='1' then 'homalt' when a[1]='1' or a[2]='1' then 'hetalt' else 'skip' end as genotype, count(*) as n from y group by 1, 2",
    "csq_af_filter": f"with x as (select case when l_orderkey%11=0 then null when l_orderkey%11=1 then '' else {_CSQ.format(s='varchar')} end as csq from lineitem), y as (select string_split(string_split(csq,',')[1],'|') as f from x where csq is not null and csq<>'')"
    " select f[1] as gene, count(*) as n from y where try_cast(f[3] as double)>5e-2 and not isnan(try_cast(f[3] as double)) group by 1",
    "vcf_germline": f"{_V} select chrom, arm, genotype, count(*) as n, cast(sum(depth) as bigint) as depth, cast(sum(alt) as bigint) as alt from ger where pos%4<>0 and genotype is not null group by all",
    "germline_collect_counts": f"{_V} select {_K}, genotype, count(*) as n, cast(sum(depth) as bigint) as depth, cast(sum(alt) as bigint) as alt from ger where genotype is not null group by all",
    "germline_store": f"{_V} select chrom, arm, genotype, count(*) as n, cast(sum(depth) as bigint) as depth, cast(sum(alt) as bigint) as alt, round(sum(alt/depth),4)+0e0 as vaf from ger where pos%4<>0 and genotype is not null group by all",
    "posteriors_by_name": f"{_V}, {_estep(keys='chrom')}, l as (select *, {_LABEL} as label from rs) select chrom, case label when 0 then 'subclonal' when 1 then 'clonal' else 'loh' end as component, count(*) as n, round(sum(lse),3)+0e0 as loglik, round(sum(greatest(r0,r1,r2)),4)+0e0 as certainty from l group by 1, 2",
    "component_rows": f"{_V}, {_estep(keys='chrom, arm')} select chrom, arm, cast({_LABEL} as int) as component, count(*) as n, cast(sum(alt) as bigint) as alt from rs group by 1, 2, 3",
    "uncertain_labels": f"{_V}, {_estep(keys='chrom, arm')} select chrom, arm, count(*) as n, cast(sum(depth) as bigint) as depth, count(*) filter (r1>5e-1) as n_middle from rs where greatest(r0,r1,r2)<9e-1 group by 1, 2",
    "germline_fit_checked": f"{_V} select chrom, count(*) filter (genotype='hetalt') as n_het, count(*) filter (genotype='homalt') as n_hom, true as loglik_is_of_rows, true as likeliest_around, true as total_is_of_rows, true as mask_is_same, case when count(*) filter (genotype='hetalt')>0 then true end as het_alone_is_same from ger group by chrom",
    "mixture_fit_checked": f"{_V}, c as (select chrom, count(*) as n from som group by all), k as (select chrom, cast(case when chrom in {_TWO_LEFT} then least(n, 2) when chrom in {_NONE_LEFT} then 0 else n end as bigint) as n_variants from c)"
    " select chrom, n_variants, case when n_variants>=3 then 'fit' when n_variants=0 then 'no variants' else 'too few' end as kind, true as loglik_holds, true as bic_holds, true as pi_holds, true as values_hold, true as no_worse_than_prior, true as optimum from k",
    "arms_checked": f"{_V}, ks as (select distinct {_K} from v), h as (select {_K}, count(*) filter (genotype='hetalt') as n_het from ger group by all), s as (select {_K}, count(*) as n from som group by all)"
    " select ks.*, coalesce(n, 0) as n_variants, case when n_het>=5 then 'germline' else 'default' end as prior_source, case when n_het>=5 then n_het end as n_het, true as fit_beside_prior, true as whole, true as optimum from ks"
    " left join h on ks.sample_id=h.sample_id and ks.chrom=h.chrom and ks.arm is not distinct from h.arm left join s on ks.sample_id=s.sample_id and ks.chrom=s.chrom and ks.arm is not distinct from s.arm",
    "germline_moments": f"{_V}, {_SUMS} select {_K}, n_het, n_hom, round(mean_het,6)+0e0 as mean_het, round(mean_hom,6)+0e0 as mean_hom, round(var_het,6)+0e0 as var_het, round(var_hom,6)+0e0 as var_hom, case when mean_het is null then null else round(mu0,6)+0e0 end as mu0, round(kappa0,2)+0e0 as kappa0 from mm",
    "germline_fallback": f"{_V}, {_SUMS} select {_K}, round(case when n_het=0 then 5e-1 when n_het<5 then greatest(3e-1, least(7e-1, mean_het)) end,6)+0e0 as mu_het, case when n_het<5 then 5e1 end as kappa_het, round(case when n_hom=0 then 98e-2 when n_hom<3 then greatest(9e-1, least(999e-3, mean_hom)) end,6)+0e0 as mu_hom, case when n_hom<3 then 1e2 end as kappa_hom from mom",
    "germline_flags": f"{_V}, {_SUMS}, {_FLAGS} select {_K}, n_het+n_hom as n_variants, round(imb,6)+0e0 as allelic_imbalance, n_het>=10 and imb>1e-1 as has_loh_signal, n_het>=10 and imb>1e-1 as has_loh_by_spec, round(confidence,6)+0e0 as confidence, cast(case when imb<5e-2 then 0 when mu_het>5e-1 then 1 else -1 end as int) as het_direction from fl",
    "somatic_prior": f"{_V}, {_SUMS}, {_FLAGS}, ks as (select distinct {_K} from v), jn as (select ks.*, n_het is not null as s, n_het>=10 and imb>1e-1 as loh, mu_het, kappa_het, confidence, 1/(5e-1+5e-1*confidence) as sc from ks left join (select * from fl where n_het>=5) f on ks.sample_id=f.sample_id and ks.chrom=f.chrom and ks.arm is not distinct from f.arm)"
    f" select {_K}, {_PRIOR_COLUMNS}, 5e-1 as kappa_prior_log_sigma, coalesce(loh, false) as loh_detected, case when s then round(confidence,6)+0e0 else 0e0 end as confidence, case when s then 'germline' else 'default' end as source from jn",
    "default_priors": f"{_V} select distinct chrom, arm, 15e-2 as mu0, 5e-1 as mu1, 85e-2 as mu2, 8e-2 as sigma0, 12e-2 as sigma1, 12e-2 as sigma2, 5e1 as kappa0, 5e1 as kappa1, 5e1 as kappa2, 2e0 as pi0, 4e0 as pi1, 2e0 as pi2, 5e-1 as kappa_prior_log_sigma, false as loh_detected, 0e0 as confidence, 'default' as source from v",
    "smart_init": f"{_V}, st as (select {_K}, count(*) filter (vaf<25e-2) as n0, count(*) filter (vaf>=35e-2 and vaf<=65e-2) as n1, count(*) filter (vaf>65e-2) as n2, avg(vaf) filter (vaf<25e-2) as m0, median(vaf) filter (vaf>=35e-2 and vaf<=65e-2) as m1, avg(vaf) filter (vaf>65e-2) as m2 from som group by all)"
    f" select {_K}, round(greatest(2e-2, least(3e-1, case when n0>5 then m0 else 15e-2 end)),6)+0e0 as mu0, round(greatest(25e-2, least(75e-2, case when n1>5 then m1 else 5e-1 end)),6)+0e0 as mu1, round(greatest(5e-1, least(99e-2, case when n2>5 then m2 else 85e-2 end)),6)+0e0 as mu2 from st",
    "bb_logpmf_by_arm": f"{_V} select chrom, arm, round(sum({_pmf('25e0', '25e0')}),3)+0e0 as loglik, count(*) as n from v group by chrom, arm",
    "estep_loglik": f"{_V}, {_estep()}, s as (select {_K}, count(*) as n, sum(lse) as ll from rs group by all) select {_K}, n, round(ll,3)+0e0 as loglik, round(-2*ll+8*ln(n),2)+0e0 as bic from s",
    "em_pi_update": f"{_V}, {_estep()}, s as (select {_K}, sum(r0)+2e0 as e0, sum(r1)+4e0 as e1, sum(r2)+2e0 as e2 from rs group by all) select {_K}, round(e0/(e0+e1+e2),6)+0e0 as pi0, round(e1/(e0+e1+e2),6)+0e0 as pi1, round(e2/(e0+e1+e2),6)+0e0 as pi2 from s",
    "predict_labels": f"{_V}, {_estep(keys='chrom, arm')} select chrom, arm, cast({_LABEL} as int) as label, cast(case when greatest(r0,r1,r2)<9e-1 then -1 else {_LABEL} end as int) as sure_label, count(*) as n from rs group by 1, 2, 3, 4",
    "component_summary": f"{_V}, {_estep(keys='chrom, arm')}, l as (select *, {_LABEL} as label from rs) "
    + " union all ".join(f"select chrom, arm, '{n}' as component, {SPEC.mu_default[k]!r}::double as mu, 5e1 as kappa, {SPEC.pi_prior_default[k] / 8!r}::double as pi, count(*) filter (label={k}) as n_assigned, round(avg(r{k}),6)+0e0 as mean_responsibility from l group by chrom, arm" for k, n in enumerate(sp.COMPONENTS)),
    "germline_grid_mle": f"""{_V}, h as (select chrom, alt, depth, count(*) as w from ger where genotype='hetalt' group by all),
grid as (select mi, ki, 1e-1+8e-1*(mi/16e0) as mu, 5e0*pow(200e0, ki/8e0) as kappa from (select unnest(range(17)) as mi) a, (select unnest(range(9)) as ki) c),
ab as (select mi, ki, mu*kappa as a, (1-mu)*kappa as b from grid),
sc as (select chrom, mi, ki, round(sum(w*{_pmf('a', 'b')}), 4) as ll from h, ab group by all),
bs as (select *, row_number() over (partition by chrom order by ll desc, mi, ki) as rn from sc)
select chrom, cast(mi as int) as mu_i, cast(ki as int) as kappa_i, ll+0e0 as loglik from bs where rn=1""",
    "em_mu_grid_step": _map_sql(
        "mu",
        f"({_case([b[0] for b in SPEC.bounds_mu])})+(({_case([b[1] for b in SPEC.bounds_mu])})-({_case([b[0] for b in SPEC.bounds_mu])}))*i/1e1",
        "5e1",
        f"pow((mu-({_case(SPEC.mu_default)}))/({_case(SPEC.mu_prior_sigma_default)}), 2)",
    ),
    "em_kappa_grid_step": _map_sql("kappa", _case(SPEC.mu_default), "5e0*pow(100e0, i/1e1)", "pow(ln(kappa/5e1)/5e-1, 2)"),
    "em_slopes": f"{_V}, {_estep(_OFF_MU, 'chrom', _OFF_KAPPA)} " + " union all ".join(_slopes_sql(k) for k in range(3)),
    "best_restart": f"{_V}, " + "all_ as (" + " union all ".join(f"(with {_estep(mu)} select {_K}, {i} as restart, round(sum(lse),4) as ll from rs group by {_K})" for i, mu in enumerate(_RESTARTS)) + f"), bs as (select *, row_number() over (partition by {_K} order by ll desc, restart) as rn from all_) select {_K}, cast(restart as int) as restart, ll+0e0 as loglik from bs where rn=1",
}
ORACLE_SQL["vcf_block_gzip"] = ORACLE_SQL["vcf_germline"]
