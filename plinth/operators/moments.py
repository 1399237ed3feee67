"""Grouped moments, merges, quantiles and shapes. All are built-in aggregates: partial sums combine before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.binning import finite


def cell_moments(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y", "z"), least: int = 1) -> DataFrame:
    """n, means, population covariances, least and greatest of the axes. The covariances are centred updates, safe far from the origin."""
    aggs = [F.count("*").alias("n")]
    for i, a in enumerate(axes):
        aggs += [F.avg(a).alias(f"m{a}"), F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}")]
        aggs += [F.covar_pop(a, b).alias(f"s{a}{b}") for b in axes[i:]]
    return df.groupBy(*keys).agg(*aggs).where(F.col("n") >= least)


def sample_moments(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y"), least: int = 2) -> DataFrame:
    """The same with sample covariances, 0 for a single row."""
    aggs = [F.count("*").alias("n")]
    for i, a in enumerate(axes):
        aggs.append(F.avg(a).alias(f"m{a}"))
        aggs += [F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"s{a}{b}") for b in axes[i:]]
    return df.groupBy(*keys).agg(*aggs).where(F.col("n") >= least)


def finite_extremes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, median and greatest of the finite values; groups without any have nulls."""
    v = F.when(finite(F.col(value)), F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("greatest"))


def robust_low(df: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Least, second least (a repeated least counts), greatest; low is the second where it stands clear of the least by more than gap."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    low = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.min(F.when(F.col("__r") == 2, F.col(value))).alias("second"), F.max(value).alias("highest"))
    return low.withColumn("robust_low", F.when(F.col("second") - F.col("lowest") > gap, F.col("second")).otherwise(F.col("lowest")))


def weighted_moments(df: DataFrame, keys: list[str], weight: Column, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Total weight, weighted means and covariances; two passes, so that the covariances keep their digits."""
    w = df.withColumn("__w", weight)
    first = w.groupBy(*keys).agg(F.sum("__w").alias("mass"), *(F.sum(F.col("__w") * F.col(a)).alias(f"__{a}") for a in axes))
    means = first.select(*keys, "mass", *((F.col(f"__{a}") / F.col("mass")).alias(f"m{a}") for a in axes))
    centred = w.join(means, keys)
    covs = [F.sum(F.col("__w") * (F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}")) / F.col("mass")).alias(f"s{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    return centred.groupBy(*keys, "mass", *(f"m{a}" for a in axes)).agg(*covs)


def merge_moments(parts: DataFrame, keys: list[str], count: str = "n", axes: tuple[str, ...] = ("x", "y"), saturation: float | None = None, least: float = 0.0) -> DataFrame:
    """Parallel-axis merge of (n, m*, s**) rows into one of their union; support is 1 - exp(-n / saturation)."""
    n = F.col(count)
    sums = [F.sum(n).alias("__n"), *(F.sum(n * F.col(f"m{a}")).alias(f"__{a}") for a in axes)]
    sums += [F.sum(n * (F.col(f"s{a}{b}") + F.col(f"m{a}") * F.col(f"m{b}"))).alias(f"__{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    g = parts.groupBy(*keys).agg(*sums).where(F.col("__n") >= least)
    mean = {a: F.col(f"__{a}") / F.col("__n") for a in axes}
    out = [*keys, F.col("__n").alias("n"), *(mean[a].alias(f"m{a}") for a in axes)]
    out += [(F.col(f"__{a}{b}") / F.col("__n") - mean[a] * mean[b]).alias(f"s{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    if saturation:
        out.append((1 - F.exp(-F.col("__n") / saturation)).alias("support"))
    return g.select(*out)


def linear_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact quantiles, linear at (n - 1) p."""
    q = F.percentile(value, F.array(*map(F.lit, at)))
    return df.groupBy(*keys).agg(q.alias("__q")).select(*keys, *(F.col("__q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(at)))


def midpoint_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact quantiles where the i-th of n values stands at (i - 0.5) / n; linear between, held at the ends."""
    by = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.col(value).alias("__v"), F.row_number().over(by.orderBy(value)).alias("__i"), F.count("*").over(by).alias("__n"))
    aggs = []
    for p in at:
        place = F.least(F.greatest(F.col("__n") * p + 0.5, F.lit(1.0)), F.col("__n").cast("double"))
        low, part = F.floor(place), place - F.floor(place)
        aggs.append(F.sum(F.when(F.col("__i") == low, F.col("__v") * (1 - part)).when(F.col("__i") == low + 1, F.col("__v") * part).otherwise(0.0)).alias(f"q{round(p * 100)}"))
    return ranked.groupBy(*keys).agg(*aggs)


def decile_entropy(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Normalised entropy and occupied share of a histogram between a group's least and greatest value."""
    by = Window.partitionBy(*keys)
    low, high = F.min(value).over(by), F.max(value).over(by)
    b = F.least(F.lit(bins - 1), F.floor(bins * (F.col(value) - low) / F.greatest(high - low, F.lit(1e-12)))).cast("int")
    counted = df.select(*keys, b.alias("__b")).groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    p = F.col("__c") / F.sum("__c").over(by)
    return counted.select(*keys, "__b", p.alias("__p")).groupBy(*keys).agg((-F.sum(F.col("__p") * F.ln("__p")) / F.ln(F.lit(float(bins)))).alias("entropy"), (F.count("*") / F.lit(float(bins))).alias("occupied"))


def distribution_shape(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population skewness, raw kurtosis, quantile spans and the largest gap of neighbours over the span."""
    by = Window.partitionBy(*keys).orderBy(value)
    gaps = df.withColumn("__g", F.col(value) - F.lag(value).over(by))
    q = F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"), q.alias("__q"), F.max("__g").alias("__m"), F.min(value).alias("__a"), F.max(value).alias("__b"))
    span = F.greatest(F.col("__b") - F.col("__a"), F.lit(1e-12))
    return g.select(*keys, "n", "skew", "kurt", (F.col("__q")[4] - F.col("__q")[0]).alias("span80"), (F.col("__q")[3] - F.col("__q")[1]).alias("span50"), (F.col("__m") / span).alias("gap_ratio"))


def representatives(df: DataFrame, keys: list[str], distance: Column, ties: list[str]) -> DataFrame:
    """The row of each group that is nearest to its reference, ties by the given columns."""
    ranked = df.withColumn("__d", distance)
    return ranked.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__d", *ties))).where("__r = 1").drop("__r", "__d")


def normalised_weights(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """weight over its group's total; equal shares where the total is 0."""
    by = Window.partitionBy(*keys)
    total = F.sum(weight).over(by)
    return df.withColumn("share", F.when(total == 0, 1 / F.count("*").over(by)).otherwise(F.col(weight) / F.when(total == 0, F.lit(1.0)).otherwise(total)))


def least_squares(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def plane_fit(df: DataFrame, keys: list[str], weight: Column, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Weighted least squares z = a + b x + c y, by centred normal equations and Cramer's rule; null where they are singular."""
    m = weighted_moments(df, keys, weight, (x, y, z))
    sxx, sxy, syy, sxz, syz = (F.col(f"s{a}") for a in (x + x, x + y, y + y, x + z, y + z))
    det = sxx * syy - sxy * sxy
    ok = det > 1e-12
    b = F.when(ok, (sxz * syy - syz * sxy) / F.when(ok, det))
    c = F.when(ok, (syz * sxx - sxz * sxy) / F.when(ok, det))
    return m.select(*keys, "mass", (F.col(f"m{z}") - b * F.col(f"m{x}") - c * F.col(f"m{y}")).alias("a"), b.alias("b"), c.alias("c"))


def plane_modes(df: DataFrame, keys: list[str], weight: Column, apart: float, ratio: float, balance: float = 0.15) -> DataFrame:
    """keys, variance, within, apart, two_modes: whether the residuals of the weighted plane fall into a lower and an upper mode.

    So they do if both halves have weight enough, their means stand apart, and little variance is left within them.
    """
    d = df.withColumn("__w", weight)
    r = d.join(plane_fit(d, keys, F.col("__w")), keys).withColumn("__r", F.col("z") - F.col("a") - F.col("b") * F.col("x") - F.col("c") * F.col("y"))
    halves = r.groupBy(*keys, (F.col("__r") <= 0).alias("__low")).agg(F.sum("__w").alias("__m"), (F.sum(F.col("__w") * F.col("__r")) / F.sum("__w")).alias("__a"), F.sum(F.col("__w") * F.col("__r") ** 2).alias("__q"))
    total = F.sum("__m")
    g = halves.groupBy(*keys).agg(F.count("*").alias("__k"), (F.sum("__q") / total).alias("variance"), ((F.sum("__q") - F.sum(F.col("__m") * F.col("__a") ** 2)) / total).alias("within"), (F.min("__m") / total).alias("__b"), (F.max("__a") - F.min("__a")).alias("apart"))
    return g.withColumn("two_modes", (F.col("__k") == 2) & (F.col("__b") > balance) & (F.col("apart") > apart) & (F.col("within") < ratio * F.col("variance"))).drop("__k", "__b")


def height_order(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Order statistics of whole groups: the greatest gap and the quartile span over the span, standardised moments, halves between the median and the 5th and 95th percentile (midpoint rule)."""
    gaps = df.withColumn("__g", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value)))
    g = gaps.groupBy(*keys).agg(F.max("__g").alias("__m"), (F.max(value) - F.min(value)).alias("__s"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    q = midpoint_quantiles(df, keys, value, [0.05, 0.25, 0.5, 0.75, 0.95])
    wide = F.col("__s") > 0
    j = g.join(q, keys)
    over = lambda c: F.when(wide, c / F.when(wide, F.col("__s"))).otherwise(0.0)
    return j.select(*keys, over(F.col("__m")).alias("gap_ratio"), over(F.col("q75") - F.col("q25")).alias("quartile_ratio"), "skew", "kurt", (F.col("q50") - F.col("q5")).alias("lower_half"), (F.col("q95") - F.col("q50")).alias("upper_half"))


def higher_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """21 measures of the shape of a population of x, y, z: standardised heights, their quantiles and histogram, spread across and about a leaning axis."""
    by = Window.partitionBy(*keys)
    low, high = F.min("z").over(by), F.max("z").over(by)
    d = df.select(*keys, *((F.col(a) - F.avg(a).over(by)).alias(f"d{a}") for a in "xyz"), ((F.col("z") - low) / F.greatest(high - low, F.lit(1e-10))).alias("u"), (high - low).alias("span"), F.count("*").over(by).alias("n"))
    d = d.withColumn("rad", F.col("dx") ** 2 + F.col("dy") ** 2).withColumn("gap", F.col("u") - F.lag("u").over(by.orderBy("u")))
    v = F.avg(F.col("dz") ** 2).over(by)
    d = d.withColumns({"v": v, "tx": F.col("dx") - F.avg(F.col("dx") * F.col("dz")).over(by) / F.greatest(v, F.lit(1e-14)) * F.col("dz"), "ty": F.col("dy") - F.avg(F.col("dy") * F.col("dz")).over(by) / F.greatest(v, F.lit(1e-14)) * F.col("dz")})
    d = d.withColumns({"bin": F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.floor(F.col("u") * 1e10 + 0.5) / 1e10 * 10) + 1)), "t2": F.col("tx") ** 2 + F.col("ty") ** 2, "e": F.col("dz") ** 2 - F.col("v")})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m2 = F.avg(F.col("dz") ** 2)
    q = F.percentile("u", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = d.groupBy(*keys).agg(
        F.first("n").alias("n"), (F.avg(F.col("dz") ** 3) / F.greatest(m2**1.5, F.lit(1e-15))).alias("skew"), (F.avg(F.col("dz") ** 4) / F.greatest(m2**2, F.lit(1e-20))).alias("kurt"),
        (F.avg(F.col("rad") ** 2) / F.greatest(F.avg("rad") ** 2, F.lit(1e-20))).alias("radial_kurt"), F.avg("u").alias("level"), (m2 / F.greatest(F.max("span") ** 2, F.lit(1e-20))).alias("spread"),
        share(F.col("u") < 0.25).alias("low"), share(F.col("u").between(0.25, 0.75)).alias("mid"), share(F.col("u") > 0.75).alias("high"), q.alias("q"), F.max("gap").alias("gap"), F.corr("dz", "rad").alias("coupling"),
        F.percentile(F.sqrt("t2"), F.lit(0.9)).alias("lean90"), F.max(F.sqrt("t2")).alias("lean_max"), (F.avg(F.col("t2") ** 2) / F.greatest(F.avg("t2") ** 2, F.lit(1e-20))).alias("lean_kurt"),
        F.least(F.lit(1.0), F.sqrt(F.avg(F.col("e") * F.col("tx")) ** 2 + F.avg(F.col("e") * F.col("ty")) ** 2) / F.sqrt(F.avg(F.col("e") ** 2) * F.avg("t2"))).alias("bow"),
    )
    counted = d.groupBy(*keys, "bin").agg((F.count("*") / F.first("n")).alias("p")).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(10.0))).alias("entropy"), F.max("p").alias("mode"), F.count("*").alias("__b"))
    a, b, c, e, f = (F.col("q")[i] for i in range(5))
    g = g.join(counted, keys).withColumns({"span50": e - b, "span80": f - a, "median": c, "tilt": (f + a - 2 * c) / F.greatest(f - a, F.lit(1e-10)), "bins": F.col("__b") / F.least("n", F.lit(10))})
    return g.drop("q", "__b", "n")
