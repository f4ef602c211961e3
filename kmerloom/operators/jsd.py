"""Entropy and Jensen-Shannon divergence of sets of frequency vectors, in sparse long form.

A set's members are rows (set columns, member, kmer, freq), one for each non-zero frequency; `member` is unique in its
set, so a record that is listed twice is two members. With S the sums of the frequencies and N the members of a set,
leaving member i out changes S only at the k-mers of i, so all members of all sets are done by one join on
(set, kmer): H(S - f_i) = base + sum over i's k-mers of g((S - f) / (N - 1)) - g(S / (N - 1)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Differences up to the spacing of doubles at 1 are rounding, not frequencies.
EPS = 2.220446049250313e-16


def g(x: Column) -> Column:
    """-x log2 x, and 0 for 0 and for rounding below it."""
    return F.when(x > EPS, -x * F.log2(x)).otherwise(F.lit(0.0))


def entropy_of(vector: Column) -> Column:
    """Shannon entropy of a dense frequency array."""
    return F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + g(x))


def checked_entropy_of(vector: Column) -> Column:
    """entropy_of, raising for arrays that are empty or do not sum to 1."""
    total = F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + x)
    bad = (F.size(vector) == 0) | (F.abs(total - 1.0) > F.size(vector) * F.lit(EPS))
    return F.when(bad, F.raise_error(F.lit("frequencies must sum to 1")).cast("double")).otherwise(entropy_of(vector))


def long_form(vectors: DataFrame, keep: list[str], vector: str = "kfreqs") -> DataFrame:
    """Non-zero elements of dense arrays: the kept columns, kmer (0-based) and freq."""
    return vectors.select(*keep, F.posexplode(vector).alias("kmer", "freq")).where("freq <> 0")


def member_entropy(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by, "member").agg(F.sum(g(F.col("freq"))).alias("entropy"))


def set_sums(members: DataFrame, by: list[str]) -> DataFrame:
    """Sum of frequencies of each k-mer of each set."""
    return members.groupBy(*by, "kmer").agg(F.sum("freq").alias("total"))


def set_divergence(members: DataFrame, by: list[str]) -> DataFrame:
    """size, summed_entropies, total_jsd and mean_jsd of each set."""
    own = member_entropy(members, by).groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.sum("entropy").alias("summed_entropies"))
    spread = set_sums(members, by).join(own, by).groupBy(*by, "size", "summed_entropies").agg(F.sum(g(F.col("total") / F.col("size"))).alias("h"))
    total = F.col("h") - F.col("summed_entropies") / F.col("size")
    return spread.select(*by, "size", "summed_entropies", total.alias("total_jsd"), (total / F.col("size")).alias("mean_jsd"))


def leave_one_out(members: DataFrame, by: list[str]) -> DataFrame:
    """member, entropy, delta_jsd (total divergence less that of the set without the member) and total_jsd.

    A set of one member has no set without it: its delta_jsd is null.
    """
    sums = set_sums(members, by)
    own = member_entropy(members, by)
    rest = F.col("size") - 1
    sets = own.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.sum("entropy").alias("all_h"))
    scalars = (
        sums.join(sets, by)
        .groupBy(*by, "size", "all_h")
        .agg(F.sum(g(F.col("total") / F.col("size"))).alias("h"), F.sum(g(F.col("total") / F.when(rest > 0, rest))).alias("base"))
    )
    changed = (
        members.join(sums, [*by, "kmer"])
        .join(scalars, by)
        .groupBy(*by, "member", "size", "all_h", "h", "base")
        .agg(F.sum(g(F.col("freq"))).alias("entropy"), F.sum(g((F.col("total") - F.col("freq")) / F.when(rest > 0, rest)) - g(F.col("total") / F.when(rest > 0, rest))).alias("change"))
    )
    total = F.col("h") - F.col("all_h") / F.col("size")
    without = F.col("base") + F.col("change") - (F.col("all_h") - F.col("entropy")) / F.when(rest > 0, rest)
    return changed.select(*by, "member", "size", "entropy", F.when(rest > 0, total - without).alias("delta_jsd"), total.alias("total_jsd"))


def set_statistics(deltas: DataFrame, by: list[str]) -> DataFrame:
    """From leave_one_out(): size, total_jsd, lowest member, and mean, standard deviation (n - 1) and cov of delta_jsd.

    Of members with equal delta_jsd (to 12 decimals) the first is the lowest.
    """
    return deltas.groupBy(*by).agg(
        F.max("size").alias("size"),
        F.max("total_jsd").alias("total_jsd"),
        F.min(F.struct(F.round("delta_jsd", 12).alias("d"), "member")).getField("member").alias("lowest"),
        F.avg("delta_jsd").alias("mean_delta_jsd"),
        F.stddev_samp("delta_jsd").alias("std_delta_jsd"),
        (F.stddev_samp("delta_jsd") / F.avg("delta_jsd")).alias("cov_delta_jsd"),
    )


def replaced_divergence(members: DataFrame, by: list[str], queries: DataFrame) -> DataFrame:
    """For each query, the total divergence of its reference set after the set's lowest member is replaced by the query.

    members and queries have (set columns, member, name, kmer, freq); in queries the set columns say which set a query
    is held against. A query whose name is a member's gives exactly 0. Only k-mers of the query or the lowest member
    change a sum, so the rest of a set enters as one number. Queries of sets that have no members are left out.
    """
    deltas = leave_one_out(members, by)
    low = set_statistics(deltas, by).select(*by, F.col("lowest").alias("member"), "size")
    lowest = members.join(low, [*by, "member"]).select(*by, "kmer", F.col("freq").alias("low"))
    reduced = set_sums(members, by).join(lowest, [*by, "kmer"], "left").withColumn("rest", F.col("total") - F.coalesce("low", F.lit(0.0)))
    reduced = reduced.select(*by, "kmer", F.when(F.col("rest") > EPS, F.col("rest")).otherwise(0.0).alias("rest"))
    others = deltas.join(low.select(*by, F.col("member").alias("low_member")), by)
    entropies = others.groupBy(*by).agg(F.max("size").alias("size"), F.sum(F.when(F.col("member") != F.col("low_member"), F.col("entropy")).otherwise(0.0)).alias("rest_h"))
    base = reduced.join(entropies, by).groupBy(*by, "size", "rest_h").agg(F.sum(g(F.col("rest") / F.col("size"))).alias("base"))
    names = members.select(*by, "name").distinct().withColumn("inside", F.lit(True))
    n, rest = F.col("size"), F.coalesce("rest", F.lit(0.0))
    scored = (
        queries.join(reduced, [*by, "kmer"], "left")
        .join(base, by)
        .groupBy(*by, "member", "name", "size", "rest_h", "base")
        .agg(F.sum(g((rest + F.col("freq")) / n) - g(rest / n)).alias("change"), F.sum(g(F.col("freq"))).alias("h"))
    )
    value = F.col("base") + F.col("change") - (F.col("rest_h") + F.col("h")) / n
    return scored.join(names, [*by, "name"], "left").select(*by, "member", "name", F.when(F.col("inside"), F.lit(0.0)).otherwise(value).alias("replaced_jsd"))


def increases_divergence(replaced: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """The rows of replaced_divergence() that raise their set's total_jsd."""
    return replaced.join(sets.select(*by, "total_jsd"), by).where(F.col("replaced_jsd") > F.col("total_jsd") + F.lit(EPS))


def pairwise_divergence(members: DataFrame, by: list[str]) -> DataFrame:
    """member_a < member_b and jsd of all pairs within each set.

    With h the entropies, JSD of two is H((p + q) / 2) - (h_p + h_q) / 2, and H needs the join only where both have the
    k-mer: sum g(p / 2) + sum g(q / 2) + sum over common of g((p + q) / 2) - g(p / 2) - g(q / 2).
    """
    half = lambda x: g(F.col(x) / 2)
    own = members.groupBy(*by, "member").agg(F.sum(g(F.col("freq"))).alias("h"), F.sum(half("freq")).alias("halves"))
    a = members.select(*by, F.col("member").alias("member_a"), "kmer", F.col("freq").alias("p"))
    b = members.select(*by, F.col("member").alias("member_b"), "kmer", F.col("freq").alias("q"))
    common = a.join(b, [*by, "kmer"]).where("member_a < member_b").groupBy(*by, "member_a", "member_b").agg(F.sum(g((F.col("p") + F.col("q")) / 2) - half("p") - half("q")).alias("common"))
    x = own.select(*by, F.col("member").alias("member_a"), F.col("h").alias("ha"), F.col("halves").alias("xa"))
    y = own.select(*by, F.col("member").alias("member_b"), F.col("h").alias("hb"), F.col("halves").alias("xb"))
    every = x.join(y, by).where("member_a < member_b").join(common, [*by, "member_a", "member_b"], "left")
    value = F.col("xa") + F.col("xb") + F.coalesce("common", F.lit(0.0)) - (F.col("ha") + F.col("hb")) / 2
    return every.select(*by, "member_a", "member_b", F.greatest(value, F.lit(0.0)).alias("jsd"))


