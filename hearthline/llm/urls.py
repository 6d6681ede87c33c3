"""URL filters: explicit rules, then a ratio of two character language models. DataFrame functions only.

URLs that a rule decides are the labelled samples. Two variable-order Markov models (of accepted and of rejected URLs) hold counts of
characters after contexts of 0 to `ORDER` characters; each order is smoothed with the one below, and a context that was never seen
leaves the choice to the order below. A URL's score is its log-likelihood difference (accepted minus rejected) divided by its
characters. The threshold is the score at which false accepts and false rejects of held-back labelled URLs are fewest.

Each distinct address is scored once. Its 5-grams meet the model by a broadcast join when the model has at most `BROADCAST_ROWS` rows, else by
a join on the gram and a salt of the address, so that a frequent gram is spread.

Defined results: null urls and urls without `://` have an empty host and path and are blocked (there is nothing to fetch); with no labelled
urls all models are alike and undecided urls are allowed; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
#: Weight of the order below, in counts.
SMOOTHING = 4.0
BROADCAST_ROWS, SALTS = 200_000, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.select("page_id", F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))


def matched_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its action; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _grams(addresses: DataFrame) -> DataFrame:
    """One row for each place of an address: the character there (the last is an end) after ORDER characters."""
    padded = F.concat(F.lit("\x01" * ORDER), F.col("address"), F.lit("\x02"))
    places = F.sequence(F.lit(1), F.length("address") + 1)
    return addresses.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def model(addresses: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, ratio): the log-likelihood ratio of each 5-gram of addresses(address, action, n, held).  Only labelled addresses that aren't held back count."""
    learned = F.when(~F.col("held"), F.col("n")).otherwise(0)
    count = lambda action: F.sum(F.when(F.col("action") == action, learned).otherwise(0)).cast("double")
    counts = cut(_grams(addresses).groupBy("gram").agg(count("allow").alias("a"), count("block").alias("b")))
    sums = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    # below order 0 all characters are alike
    out = counts.select("gram", F.lit(1 / 96).alias("pa"), F.lit(1 / 96).alias("pb"))
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("s")).agg(*sums).select("s", F.col("a").alias("ca"), F.col("b").alias("cb"))
        context = counts.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("c")).agg(*sums).select("c", F.col("a").alias("ta"), F.col("b").alias("tb"))
        out = (
            out.withColumns({"s": F.substring("gram", ORDER + 1 - k, k + 1), "c": F.substring("gram", ORDER + 1 - k, k)})
            .join(seen, "s")
            .join(context, "c")
            .select("gram", ((F.col("ca") + smoothing * F.col("pa")) / (F.col("ta") + smoothing)).alias("pa"), ((F.col("cb") + smoothing * F.col("pb")) / (F.col("tb") + smoothing)).alias("pb"))
        )
    return out.select("gram", F.ln(F.col("pa") / F.col("pb")).alias("ratio"))


def score(addresses: DataFrame, ratios: DataFrame) -> DataFrame:
    """(address, score): mean log-likelihood difference of an address's characters, to six places."""
    ratios = cut(ratios)
    grams = _grams(addresses.select("address")).groupBy("address", "gram").agg(F.count("*").alias("k"))
    if ratios.count() <= BROADCAST_ROWS:
        joined = grams.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = grams.withColumn("salt", F.pmod(F.xxhash64("address"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return joined.groupBy("address").agg((F.round(F.sum(F.col("k") * F.col("ratio")) / F.sum("k"), 6)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score from which held-back labelled addresses are best accepted: least false accepts and false rejects, each as a share; steps of 0.01."""
    held = scored.where("held and action is not null")
    bins = held.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.when(F.col("action") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("action") == "block", F.col("n")).otherwise(0)).alias("b")
    )
    total = bins.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total.a or not total.b:
        return 0.0
    # bins are at most a few thousand rows, whatever the input
    below = F.expr("sum(a) over (order by bin rows between unbounded preceding and 1 preceding)")
    above = F.expr("sum(b) over (order by bin rows between current row and unbounded following)")
    cost = bins.select("bin", F.round((F.coalesce(below, F.lit(0)) / total.a + F.coalesce(above, F.lit(0)) / total.b), 6).alias("cost"))
    return cost.orderBy("cost", F.abs("bin"), "bin").first().bin / 100


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """The op9 rows: page_id, host, path, rule, verdict; and score, the method's figure (null where there is no address)."""
    rule, action = matched_rule(rules)
    urls = parse(pages).withColumn("address", F.concat("host", "path")).withColumns({"rule": rule, "action": action})
    # few bytes turn into many grams: they are spread before that
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    addresses = cut(urls.where("address <> ''").repartition(partitions, "address").groupBy("address").agg(F.count("*").alias("n"), F.max("action").alias("action")).withColumn("held", F.substring(F.md5("address"), 1, 1) < "4"))
    scored = cut(addresses.join(score(addresses, model(addresses)), "address"))
    least = threshold(scored)
    verdict = F.coalesce("action", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return urls.join(scored.select("address", "score"), "address", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
