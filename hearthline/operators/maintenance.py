"""Repairs: purged sources, wrong links, merged properties, counts and operational summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .components import _cut


def orphans_after_purge(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Properties that only the purged sources(code) list."""
    gone = listings.join(sources.select(F.col("code").alias("source_code")), "source_code", "left_semi").select("property_id").distinct()
    kept = listings.join(sources.select(F.col("code").alias("source_code")), "source_code", "left_anti").select("property_id").distinct()
    return gone.join(kept, "property_id", "left_anti")


def purge_source(tables: dict[str, tuple[DataFrame, str]], orphans: DataFrame) -> dict[str, DataFrame]:
    """tables: name -> (rows, column of the property id), each without the rows of orphans."""
    return {name: rows.join(orphans.select(F.col("property_id").alias(column)), column, "left_anti") for name, (rows, column) in tables.items()}


def mismatched_links(links: DataFrame, searches: DataFrame, properties: DataFrame) -> DataFrame:
    """Links of a sale search to a property whose address is a rental's, and the other way round."""
    kinds = properties.select("property_id", urls.transaction(F.col("url")).alias("kind")).where("kind is not null")
    rows = links.join(searches.select("search_id", "transaction_type"), "search_id").join(kinds, "property_id")
    return rows.where(F.col("kind") != F.col("transaction_type")).select("search_id", "property_id")


def recount(searches: DataFrame, links: DataFrame) -> DataFrame:
    """Results of each search, 0 where there are none."""
    n = links.groupBy("search_id").agg(F.count("*").alias("n"))
    return searches.select("search_id").join(n, "search_id", "left").select("search_id", F.coalesce("n", F.lit(0)).alias("results_count"))


def resolve_merges(merges: DataFrame) -> DataFrame:
    """(property_id, target) of merges(property_id, candidate_id) followed to the end: each round doubles the way gone. Rings end at their least member."""
    hops = _cut(merges.groupBy("property_id").agg(F.min("candidate_id").alias("target")))
    rounds = 0
    while True:
        nxt = hops.select(F.col("property_id").alias("target"), F.col("target").alias("next"))
        new = _cut(hops.join(nxt, "target", "left").select("property_id", F.coalesce("next", "target").alias("target"), (F.col("next").isNotNull() & (F.col("next") != F.col("target"))).alias("moved")))
        rounds += 1
        if not new.where("moved").limit(1).count() or rounds > 40:
            return new.select("property_id", "target")
        hops = new.select("property_id", "target")


def apply_merges(rows: DataFrame, resolved: DataFrame, column: str = "property_id") -> DataFrame:
    """rows with the column mapped to its target."""
    m = resolved.select(F.col("property_id").alias(column), F.col("target").alias("_target"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_target", column)).drop("_target")


def review_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """reviews(review_id, status, ...) after decisions(review_id, decision): GROUP is GROUPED, SEPARATE is SEPARATED."""
    rows = reviews.join(decisions, "review_id", "left")
    return rows.withColumn("status", F.when(F.col("decision") == "GROUP", "GROUPED").when(F.col("decision") == "SEPARATE", "SEPARATED").otherwise(F.col("status"))).drop("decision")


def repair_transaction(rows: DataFrame) -> DataFrame:
    """Prices by address: `-aluguel-` moves the sale price to rent, then `-venda-` moves the rent to sale, so both end as a sale."""
    u = F.lower("url")
    first = rows.withColumns({"rental_price": F.when(F.contains(u, F.lit("-aluguel-")), F.coalesce("rental_price", "sale_price")).otherwise(F.col("rental_price")), "sale_price": F.when(~F.contains(u, F.lit("-aluguel-")), F.col("sale_price"))})
    return first.withColumns({"sale_price": F.when(F.contains(u, F.lit("-venda-")), F.coalesce("sale_price", "rental_price")).otherwise(F.col("sale_price")), "rental_price": F.when(~F.contains(u, F.lit("-venda-")), F.col("rental_price"))})


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, and where there is a review_queue, its pending ones."""
    if "review_queue" in tables:
        tables = tables | {"pending_reviews": tables["review_queue"].where("status = 'PENDING'")}
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def last_runs(runs: DataFrame, scopes: DataFrame, n: int = 100) -> DataFrame:
    """The n newest runs with their scope."""
    return runs.join(scopes, "scope_id").orderBy(F.desc("run_day"), "scope_id").limit(n)
