"""Domain routing: term tables over a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed(queries: DataFrame, terms: list[tuple[str, str]], default: list[str], boosts: list[tuple] = ()) -> DataFrame:
    """queries (query_id, q) with the scores of each domain and the domains routed to.

    terms (domain, term): a term found in a query counts 3 if it has more than four letters, else 2. boosts: (domain,
    condition on q, points), in their order. Below a best score of 2 the default domains hold; else those within 1 of it
    and at 2 at least. A null query scores nothing; ties keep all domains, in alphabetical order."""
    rules = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(t).alias("term")) for d, t in terms])
    found = F.filter(rules, lambda x: F.contains(F.coalesce("q", F.lit("")), x["term"]))
    points = F.transform(found, lambda x: F.struct(x["domain"].alias("domain"), F.when(F.length(x["term"]) > 4, 3).otherwise(2).alias("n")))
    for domain, condition, n in boosts:
        points = F.concat(points, F.when(condition, F.array(F.struct(F.lit(domain).alias("domain"), F.lit(n).alias("n")))).otherwise(F.array().cast("array<struct<domain:string,n:int>>")))
    total = lambda p: F.transform(F.array_sort(F.array_distinct(p["domain"])), lambda d: F.struct(d.alias("domain"), F.aggregate(F.filter(p, lambda x: x["domain"] == d), F.lit(0), lambda a, x: a + x["n"]).alias("n")))
    out = queries.withColumn("_p", points).withColumn("_s", total(F.col("_p")))
    best = F.coalesce(F.array_max(F.col("_s.n")), F.lit(0))
    kept = F.filter("_s", lambda s: s["n"] >= F.greatest(F.lit(2), best - 1))["domain"]
    return out.select("query_id", F.map_from_entries("_s").alias("scores"), F.when(best < 2, F.array(*map(F.lit, default))).otherwise(kept).alias("domains"))


def enabled(domains, off: str, default: list[str], on: bool, explicit):
    """domains without `off` unless it is on or asked for; the default where none is left."""
    left = F.when(F.lit(on) | explicit, domains).otherwise(F.array_remove(domains, off))
    return F.when(F.size(left) == 0, F.array(*map(F.lit, default))).otherwise(left)


def metadata_threshold(candidates: DataFrame, strong: int = 65, weak: int = 8) -> DataFrame:
    """Candidates of at least `strong` where a query has one, else of at least `weak`."""
    from pyspark.sql import Window

    best = F.max("score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("_b", best).filter(F.col("score") >= F.when(F.col("_b") >= strong, strong).otherwise(weak)).drop("_b")
