"""URL filter: fixed host and path rules first, then association rules mined from the urls those rules label.

A url is a transaction of tokens (scheme, host labels, words of the path, shape of its numbers, query names, anchor)
plus, where a fixed rule fits, the item of its verdict. FP-growth finds the frequent token combinations; a combination
that implies a verdict with enough confidence and support is a rule. Tokens that stand in the same labelled urls are one
item while rules are mined: any of them says the same, and without that a single form of url with many parts would have
a frequent combination for every subset of its parts. Urls that no fixed rule fits are matched through an inverted index
that lists every rule under its rarest item. DataFrame and MLlib functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.llm.common import read
from bindmill.session import durable

MIN_SUPPORT = 0.005  # of the labelled urls
MIN_URLS = 20  # and at least so many of them
MIN_CONFIDENCE = 0.8

#: Fixed values: (rule, verdict); a rule is a host, fitting its subdomains too, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens; numbers stand as ``#`` so that pages of one form share their tokens."""
    def prefixed(prefix: str, parts: Column) -> Column:
        kept = F.filter(parts, lambda x: x != "")
        return F.transform(kept, lambda x: F.concat(F.lit(prefix), x))

    shape = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    anchor = F.when(F.instr(url, "#") > 0, F.array(F.lit("anchor"))).otherwise(F.array().cast("array<string>"))
    scheme = F.regexp_extract(F.lower(url), "^([a-z0-9+.-]*)://", 1)
    every = F.concat(prefixed("scheme:", F.array(scheme)), prefixed("host:", F.split(host, r"[.:@-]")),
                     prefixed("path:", F.split(shape, r"[/._-]")), prefixed("query:", names), anchor)
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def merge_tokens(sets: DataFrame, least: float) -> DataFrame:
    """(id, tokens) -> token, item: tokens of at least ``least`` sets; those of the same sets share an item.

    The item is the smallest of its tokens. Which sets a token is in is told by their number and by two 64-bit sums
    of hashes of their ids. With t tokens to a set and n sets there are at most t * n / least tokens here.
    """
    each = sets.select("id", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    places = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    grouped = places.groupBy("n", "mark1", "mark2").agg(F.collect_list("token").alias("alike"))
    return grouped.select(F.explode("alike").alias("token"), F.array_min("alike").alias("item"))


def items_of(sets: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """(key, tokens) -> key, items: the sorted items that a set has a token of; sets without one are left out.

    The tokens that have an item are as few as ``merge_tokens`` tells, so they go to every task if they fit there.
    """
    listed = sets.select(key, F.explode("tokens").alias("token")).join(merged, "token")
    return listed.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_urls: int = 1) -> DataFrame:
    """(tokens, verdict) -> antecedent, verdict, confidence, support, index_token, of merged items (``mine``)."""
    return mine(labelled, min_support, min_confidence, min_urls)[0]


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_urls: int = 1) -> tuple[DataFrame, DataFrame]:
    """(tokens, verdict) -> rules (antecedent, verdict, confidence, support, index_token) and token -> item.

    A rule is about items; an item is named by its smallest token and is there if any of its tokens is. Rules of
    support or confidence below the limits are pruned, and so are rules with a part that has the same confidence or
    more. ``index_token`` is the antecedent's rarest item. Rules may have any number of items. Empty input gives none.
    """
    spark = labelled.sparkSession
    columns = "antecedent array<string>, verdict string, confidence double, support double, index_token string"
    sets = durable(labelled.select("tokens", "verdict").withColumn("id", F.monotonically_increasing_id()))
    n = sets.count()
    least = max(min_support * n, min_urls)
    if not n or least > n:
        return spark.createDataFrame([], columns), spark.createDataFrame([], "token string, item string")
    merged = durable(merge_tokens(sets, least))
    told = sets.join(items_of(sets, merged, "id"), "id", "left")
    none = F.array().cast("array<string>")
    items = durable(told.select(F.concat(F.coalesce("items", none), F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    min_support = least / n * (1 - 1e-12)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = durable(model.freqItemsets.withColumn("items", F.array_sort("items")))
    is_verdict = lambda x: x.startswith("=")
    with_verdict = sets.where(F.exists("items", is_verdict)).select(
        F.filter("items", lambda x: ~is_verdict(x)).alias("antecedent"),
        F.substring(F.filter("items", is_verdict)[0], 2, 1 << 20).alias("verdict"), F.col("freq").alias("both"))
    alone = sets.where(~F.exists("items", is_verdict)).select(F.col("items").alias("antecedent"), F.col("freq").alias("all"))
    rules = durable(with_verdict.where(F.size("antecedent") > 0).join(alone, "antecedent").select(
        "antecedent", "verdict", (F.col("both") / F.col("all")).alias("confidence"),
        (F.col("both") / F.lit(n)).alias("support")).where(F.col("confidence") >= min_confidence))
    # a rule's parts with one token less: one for each token
    parts = rules.where(F.size("antecedent") > 1).select(
        "verdict", "confidence", F.col("antecedent").alias("whole"), F.explode("antecedent").alias("left_out")).select(
        "verdict", "whole", F.col("confidence").alias("own"),
        F.array_remove("whole", F.col("left_out")).alias("antecedent"))
    beaten = parts.join(rules, ["antecedent", "verdict"]).where(F.col("confidence") >= F.col("own")).select(
        F.col("whole").alias("antecedent"), "verdict").distinct()
    kept = rules.join(beaten, ["antecedent", "verdict"], "left_anti")
    single = alone.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), "all")
    rarest = kept.withColumn("token", F.explode("antecedent")).join(single, "token").groupBy("antecedent", "verdict").agg(
        F.min_by("token", F.struct("all", "token")).alias("index_token"))
    rules = durable(kept.join(rarest, ["antecedent", "verdict"]).select(
        "antecedent", "verdict", "confidence", "support", "index_token"))
    return rules, merged


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens) -> tokens, verdict of the best rule whose tokens are all there; sets without a rule are left out.

    Best is the highest confidence, then support, then the longer rule, then verdict and tokens by their order.
    """
    return _match(token_sets.select("tokens", F.col("tokens").alias("items")), rules)


def _match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, items) -> tokens, mined."""
    listed = sets.select("tokens", "items", F.explode("items").alias("index_token"))
    hit = listed.join(rules, "index_token").where(F.size(F.array_except("antecedent", "items")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent"), "verdict", "antecedent")
    return hit.groupBy("tokens").agg(F.max_by("verdict", rank).alias("mined"))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A url that no fixed rule and no mined rule fits gets ``default``, null and empty urls among them. Every distinct
    set of tokens is matched once; its verdict returns to its urls by the set's hash. Urls of any length are taken
    whole. A mined rule rests on ``MIN_URLS`` labelled urls or more, so a small table may have none.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`").cast("string")
    host, path = url_parts(address)
    split_up = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), address.alias("address"),
                            host.alias("host"), path.alias("path"))
    rule, says = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = split_up.select("row", "host", "path", rule.alias("rule"), says.alias("says"),
                             url_tokens(F.col("address"), F.col("host"), F.col("path")).alias("tokens"))
    rules_found, merged = mine(judged.where(F.col("says").isNotNull()).select("tokens", F.col("says").alias("verdict")),
                               min_urls=MIN_URLS)
    open_sets = judged.where(F.col("says").isNull()).select("tokens").distinct()
    verdicts = durable(_match(items_of(open_sets, merged, "tokens"), rules_found).select(F.xxhash64("tokens").alias("set_hash"),
                                                            F.col("tokens").alias("set_tokens"), "mined"))
    needed = F.when(F.col("says").isNull(), F.xxhash64("tokens"))
    joined = judged.join(verdicts, (needed == F.col("set_hash")) & (F.col("tokens") == F.col("set_tokens")), "left")
    return joined.select("row.*", "host", "path", "rule",
                         F.coalesce("says", "mined", F.lit(default)).alias("verdict"))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, fixed rule and verdict."""
    return judge_urls(read(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_rules": op5_url_rules}
ORACLES: dict[str, str] = {}
