"""URL filters: given rules first, mined association rules for the rest.

Urls that a given rule decides are the labelled transactions.  FP-growth mines
their token combinations together with the verdict; combinations whose verdict
has enough support and confidence become rules.  Every url is reduced to the set
of tokens that occur in any mined rule, equal sets are judged once, and a set
meets only the rules listed under its tokens: each rule stands in the index
under the rarest of its tokens.

Tokens that stand in exactly the same labelled urls are one item to the miner:
the host and its parents, words and path of a site built from one template would
else be listed in all their combinations, which have the same support.  A url
holds such an item if it holds any of its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from moraine.session import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text of the rule, its verdict): the longest that fits the host or a parent of it and starts the path."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host and its parents, words of the host, path segments, ending, names of parameters."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda w: F.concat(F.lit("word:"), w))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(
        F.lit("path:"), F.regexp_replace(s, "[0-9]+", "0")))
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(tail, "&"), lambda s: s != ""), lambda s: F.concat(
        F.lit("name:"), F.substring_index(s, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    every = F.array_distinct(F.concat(scheme, parents, words, segments, names))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def alike(labelled: DataFrame) -> DataFrame:
    """token, item: the first of all tokens that stand in the same rows of ``labelled``.

    A token's rows are known by their number and three digests, which add up in
    any order, so no list of rows is gathered; equal rows are counted once.
    """
    sets = labelled.select("tokens").distinct().select("tokens", F.xxhash64("tokens").alias("h"), F.xxhash64("tokens", F.lit(7)).alias("g"))
    marks = sets.select(F.explode("tokens").alias("token"), "h", "g").groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor("g").alias("y"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFF))).alias("low"))
    same = marks.groupBy("n", "x", "y", "low").agg(F.min("token").alias("item"))
    return staged(marks.join(same, ["n", "x", "y", "low"]).select("token", "item"), "url-alike")


def with_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """tokens, items: each distinct token set with the items it holds, in order."""
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    return found.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, support: float, confidence: float, most_items: int | None = None) -> DataFrame:
    """items, verdict, confidence, support, lead (rarest item) of the rules found in ``labelled`` (tokens, known).

    Support and confidence bound their number; ``most_items`` may bound their length.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "known"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = staged(model.associationRules.filter(
        F.col("consequent")[0].isin("=allow", "=block") & (F.lit(True) if most_items is None else F.size("antecedent") <= most_items)
        & (F.size(F.filter("antecedent", lambda x: x.startswith("="))) == 0)), "url-rules")
    single = staged(model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq"),
                    "url-items")
    numbered = rules.select("antecedent", F.substring(F.col("consequent")[0], 2, 5).alias("verdict"), "confidence",
                            "support")
    lead = numbered.withColumn("item", F.explode("antecedent")).join(single, "item").groupBy(
        "antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("lead"))
    return staged(lead.withColumnRenamed("antecedent", "items"), "url-mined")


def judge_urls(pages: DataFrame, rules=RULES, support: float = 0.02, confidence: float = 0.6, most_items: int | None = None,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict, and the mined items that decided the rest.

    Of the mined rules that fit, the surest decides, then the best supported, the
    longest, the first by its items; without any the commoner verdict among the
    labelled urls does, ``allow`` if there are none.  Null urls and urls without
    :// have an empty host and path and no tokens.
    """
    host, path = F.col("host"), F.col("path")
    rule, known = given_rule(host, path, rules)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")) \
        .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))) \
        .withColumn("tokens", F.array_sort(url_tokens(F.col("url"), host, path))) \
        .withColumn("rule", rule).withColumn("known", known).drop("url")
    rows = staged(rows, "url-rows")
    labelled = rows.filter("known IS NOT NULL")
    counts = {r.known: r["count"] for r in labelled.groupBy("known").count().collect()}
    usual = "block" if counts.get("block", 0) > counts.get("allow", 0) else "allow"
    if not counts:
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.lit(usual).alias("verdict"),
                           F.lit(None).cast("string").alias("mined"))
    items = alike(labelled)
    named = with_items(labelled.select("tokens").distinct(), items)
    baskets = labelled.select("tokens", "known").join(named, "tokens", "left").select(
        F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "known")
    mined = mine_rules(baskets, support, confidence, most_items)
    open_sets = rows.filter("known IS NULL").groupBy("tokens").agg(F.count("*").alias("n"))
    used = items.join(mined.select(F.explode("items").alias("item")).distinct(), "item", "left_semi")
    # a set is reduced to the items that occur in rules, so that few different sets are left
    reduced = staged(with_items(open_sets, used).withColumnRenamed("items", "set"), "url-sets")
    met = reduced.select("set").distinct().select("set", F.explode("set").alias("lead")).join(mined, "lead") \
        .filter(F.forall("items", lambda x: F.array_contains("set", x)))
    best = met.groupBy("set").agg(F.max(F.struct(
        "confidence", "support", F.size("items").alias("n"), F.array_join("items", " ").alias("items"), "verdict")).alias("b"))
    judged = staged(reduced.join(best, "set").select("tokens", F.col("b.verdict").alias("said"), F.col("b.items").alias("mined")),
                    "url-judged")
    decided = rows.filter("known IS NOT NULL").select(
        "id", "host", "path", "rule", F.col("known").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    rest = rows.filter("known IS NULL").join(judged, "tokens", "left").select(
        "id", "host", "path", "rule", F.coalesce("said", F.lit(usual)).alias("verdict"), "mined")
    return decided.unionByName(rest).withColumnRenamed("id", id_col)
