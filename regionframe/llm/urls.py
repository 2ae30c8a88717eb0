"""URL filter: blocklist rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

Native: SQL functions for parsing, rules and features; the trees are grown and applied by the session's own ML engine.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.llm.shared import staged, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("url_len", "host_len", "path_len", "query_len", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "params", "fragment", "secure", "tld_rate", "domain_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Bits a character."""
    n = F.length(s)
    part = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + part(c) * F.log2(part(c)))).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """The lexical features of url, host and path, all numbers and never null."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    digits = lambda s: F.coalesce(F.try_divide(F.length(F.regexp_replace(s, "[^0-9]", "")), F.length(s)), F.lit(0.0))
    return pages.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"), "query_len": F.length(query).cast("double"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), "."), "digits": digits(url), "host_digits": digits(F.col("host")), "hyphens": count(F.col("host"), "-"),
        "entropy": _entropy(url), "params": count(query, "="), "fragment": url.contains("#").cast("double"), "secure": url.startswith("https").cast("double"),
        "tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })


def judged(pages: DataFrame, rules=RULES, max_train: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and p_block, the trees' probability of block.

    The labelled urls are those that a rule fits; the trees are fitted on at most max_train different ones,
    drawn by a hash of the url and weighted by their rows. Suffix statistics are the smoothed block rates of the last and
    the last two labels of the host among all labelled rows. A url that a rule fits has the rule's verdict; else block where
    p_block > 0.5. Without labelled urls of both kinds p_block is their share of block, 0 without any. A null url is
    judged as an empty one. Repeated rows are judged each; an empty table gives no row; other columns are left out.
    """
    p = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    p = p.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("fits.rule"), "ruled": F.col("fits.verdict")}).drop("fits")
    labelled = p.where("ruled is not null")
    # equal urls have equal labels: one row with its number
    distinct = labelled.groupBy("url", "host", "path", "ruled").agg(F.count("*").cast("double").alias("weight")).withColumn("label", (F.col("ruled") == "block").cast("double")).drop("ruled")
    distinct = staged(distinct, "labelled-urls")
    seen = distinct.agg(F.count("*").alias("urls"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("label") * F.col("weight")), F.lit(0.0)).alias("block")).first()
    prior = seen["block"] / seen["n"] if seen["n"] else 0.0
    share = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1_000_000)) < F.lit(min(1_000_000, 900_000 * max_train // max(seen["urls"], 1)))
    drawn = lexical(distinct.where(share))
    suffixes = distinct.withColumns({"tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    rates = {c: staged(suffixes.groupBy(c).agg(((F.sum(F.col("label") * F.col("weight")) + 4 * prior) / (F.sum("weight") + 4)).alias(f"{c}_rate")), f"{c}-rates") for c in ("tld", "domain")}

    def with_rates(df: DataFrame) -> DataFrame:
        for c, r in rates.items():
            df = df.join(r, c, "left").fillna({f"{c}_rate": prior})
        return df

    if 0 < prior < 1:
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(gather.transform(with_rates(drawn)).select("features", "label", "weight"))
        scored = model.transform(gather.transform(with_rates(lexical(p)))).withColumn("p_block", vector_to_array("probability")[1])
    else:
        scored = p.withColumn("p_block", F.lit(float(prior)))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict; a null url has empty parts and is judged by the method, repeated rows alike, a very long url by the
    same features, an empty table gives no row."""
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
