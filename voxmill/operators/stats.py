"""Entropies, pair statistics, quantile summaries and likelihood proxies, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, key: Sequence[str], *symbol: str) -> DataFrame:
    """Occurrences of each symbol in each group (partial counts combine before the shuffle)."""
    return rows.groupBy(*key, *symbol).agg(F.count("*").alias("n"))


def entropy_of_counts(counted: DataFrame, key: Sequence[str], name: str = "entropy", base2: bool = False) -> DataFrame:
    """Shannon entropy by group from a column n of counts: ln N - sum(n ln n) / N. Needs no second pass over the group."""
    log = F.log2 if base2 else F.log
    total = F.sum("n")
    value = log(total.cast("double")) - F.sum(F.col("n") * log(F.col("n").cast("double"))) / total
    out = counted.groupBy(*key).agg(F.greatest(value, F.lit(0.0)).alias(name)) if key else counted.agg(F.greatest(value, F.lit(0.0)).alias(name))
    return out


def entropy(rows: DataFrame, key: Sequence[str], *symbol: str, name: str = "entropy", base2: bool = False) -> DataFrame:
    return entropy_of_counts(counts(rows, key, *symbol), key, name, base2)


def renyi2(rows: DataFrame, key: Sequence[str], symbol: str, name: str = "renyi2") -> DataFrame:
    """-ln of the collision probability."""
    n = counts(rows, key, symbol)
    square = F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))
    return n.groupBy(*key).agg((-F.log(square)).alias(name))


def ngrams(rows: DataFrame, key: Sequence[str], order: Sequence[str], symbol: str, n: int) -> DataFrame:
    """Rows with g1..gn: each symbol and its n - 1 successors (windows that end past the sequence are left out)."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.select(*key, F.col(symbol).alias("g1"), *(F.lead(symbol, i).over(w).alias(f"g{i + 1}") for i in range(1, n)))
    return out.where(F.col(f"g{n}").isNotNull())


def ngram_entropy(grams: DataFrame, key: Sequence[str], n: int, name: str = "entropy", base2: bool = False) -> DataFrame:
    return entropy(grams, key, *(f"g{i + 1}" for i in range(n)), name=name, base2=base2)


def conditional_entropy(grams: DataFrame, key: Sequence[str], name: str = "cond_entropy") -> DataFrame:
    """H(pair) - H(first) in bits, at least 0."""
    return entropy_rate(grams, key, 2, name)


def entropy_rate(grams: DataFrame, key: Sequence[str], n: int, name: str = "rate") -> DataFrame:
    """H(last of n | the n - 1 before it) in bits, at least 0."""
    g = [f"g{i + 1}" for i in range(n)]
    full = counts(grams, key, *g)
    joint = entropy_of_counts(full, key, "joint", True)
    context = entropy_of_counts(full.groupBy(*key, *g[:-1]).agg(F.sum("n").alias("n")), key, "context", True)
    return joint.join(context, list(key)).select(*key, F.greatest(F.lit(0.0), F.col("joint") - F.col("context")).alias(name))


def repeat_mass(grams: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Share of n-grams that occur more than once, and the rate of distinct ones."""
    c = counts(grams, key, *(f"g{i + 1}" for i in range(n)))
    return c.groupBy(*key).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeat_mass"), (F.count("*") / F.sum("n")).alias("distinct_rate"))


def directed_pairs(pairs: DataFrame, key: Sequence[str], source: str = "tok", target: str = "other", direction: str = "dir") -> DataFrame:
    """Entropies (bits) of pair, source with direction, target, direction; conditional entropy and mutual information.

    All marginals come from one grouping-sets aggregation of the pair counts.
    """
    n = counts(pairs, key, source, target, direction)
    sets = [[source, target, direction], [source, direction], [target], [direction]]
    cols = [source, target, direction]
    flat = n.groupingSets([[*key, *s] for s in sets], *key, *cols).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    full = {"pair": 0, "src_dir": 0b010, "tgt": 0b101, "dir": 0b110}
    total = lambda g: F.sum(F.when(F.col("gid") == g, F.col("n"))).cast("double")
    h = lambda g: F.log2(total(g)) - F.sum(F.when(F.col("gid") == g, F.col("n") * F.log2(F.col("n").cast("double")))) / total(g)
    out = flat.groupBy(*key).agg(total(0).cast("long").alias("pairs"), *(h(g).alias(f"h_{k}") for k, g in full.items()))
    return out.withColumn("cond", F.greatest(F.lit(0.0), F.col("h_pair") - F.col("h_src_dir"))).withColumn("mi", F.greatest(F.lit(0.0), F.col("h_tgt") - F.col("cond")))


def full_domain(counted: DataFrame, size: int, code: str = "code") -> DataFrame:
    """Counts of every code 0..size-1, zeros included, with the percentage of all."""
    every = counted.sparkSession.range(size).withColumnRenamed("id", code)
    out = every.join(counted, code, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = counted.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0))).drop("total")


def summary(value: Column, prefix: str = "") -> list[Column]:
    """min, max, mean, population deviation and quantiles by linear interpolation."""
    out = [F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"), F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}std")]
    return [*out, *(F.percentile(value, F.lit(q)).alias(f"{prefix}p{round(q * 1000):03d}") for q in (0.25, 0.5, 0.75, 0.9, 0.99))]


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def additive_nll(test: DataFrame, train: DataFrame, key: Sequence[str], symbol: str) -> DataFrame:
    """Mean negative log-likelihood (bits) of the test symbols under add-one unigram estimates of the training rows."""
    seen = counts(train, key, symbol)
    sizes = seen.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    asked = counts(test, key, symbol).withColumnRenamed("n", "m")
    joined = asked.join(seen, [*key, symbol], "left").join(sizes, list(key))
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("types"))
    return joined.groupBy(*key).agg((F.sum(-F.col("m") * F.log2(p)) / F.sum("m")).alias("nll"), F.sum("m").alias("tested"))


def quantiles(rows: DataFrame, key: Sequence[str], value: str, asked: dict[str, float], ranges: int = 1024, weight: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation, one column for each name in ``asked``, without a group's values in one task.

    Distinct values are counted, then counted by ``ranges`` equal ranges between a key's least and largest value;
    running sums of these say in which ranges the asked places lie, and only those ranges are put in order. Null
    values are left out; keys must not be null.
    """
    keys = list(key) or ["_all"]
    source = rows if key else rows.withColumn("_all", F.lit(0))
    n = source.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    ends = n.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges), F.lit(ranges - 1))).otherwise(F.lit(0))
    n = n.join(ends, keys).select(*keys, "_v", "_n", part.cast("int").alias("_b"))
    sizes = n.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    run = Window.partitionBy(*keys).orderBy("_b")
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in asked.items())))
    sizes = sizes.withColumns({"_upto": F.sum("_s").over(run), "_total": F.sum("_s").over(Window.partitionBy(*keys))}).withColumn("_q", places)
    sizes = sizes.withColumn("_at", F.col("_q.q") * (F.col("_total") - 1))
    need = sizes.where((F.col("_upto") > F.floor("_at")) & (F.col("_upto") - F.col("_s") <= F.ceil("_at"))).select(*keys, "_b", (F.col("_upto") - F.col("_s")).alias("_ahead"), F.col("_q.name").alias("_name"), "_at")
    found = n.join(need.select(*keys, "_b", "_ahead").distinct(), [*keys, "_b"])
    upto = F.col("_ahead") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    met = found.withColumn("_to", upto).join(need.drop("_ahead"), [*keys, "_b"])
    holds = lambda place: (F.col("_to") - F.col("_n") <= place) & (place < F.col("_to"))
    ends_of = met.groupBy(*keys, "_name", "_at").agg(F.max(F.when(holds(F.floor("_at")), F.col("_v"))).alias("_low"), F.max(F.when(holds(F.ceil("_at")), F.col("_v"))).alias("_high"))
    value_at = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return ends_of.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, value_at)).alias(name) for name in asked)).select(*key, *asked)
