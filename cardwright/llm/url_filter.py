"""URL filters: a fixed rule list, and association rules mined from labels.

Native: URLs are cut by SQL functions, token combinations are mined by Spark's
FP-growth, and mined rules meet pages through an inverted index from a rule's
rarest token.

FP-growth finds every combination of frequent items that meet in a page, so
their number could double with each further token of one site's pages. Tokens
that too few bad pages hold are left out, and tokens that the same labelled
pages hold (a host's suffixes and labels, the fixed words of a path) count as
one item: all combinations of them have the same pages, so none can be a better
rule than any one of them. A rule is a list of such items, each with its
tokens; a URL fits that has a token of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "@bad"


@dataclass(frozen=True)
class MiningParams:
    """A mined rule holds (token combination and label) for ``min_support`` of
    the labelled pages and for ``min_count`` of them or more, is right for
    ``min_confidence`` of those that it fits or more, and beats the share of
    bad pages by the factor ``min_lift`` or has a share of good pages lower than
    theirs by the factor ``min_conviction``. The two agree where half of the pages
    are bad; above, lift alone would soon be out of reach even for a sure rule."""

    min_support: float = 0.002
    min_count: int = 20
    min_confidence: float = 0.6
    min_lift: float = 1.5
    min_conviction: float = 2.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule ``host/path`` fits its host and all subdomains where the URL's path
    starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, judged in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` the host's dot-separated suffixes beyond its top
    level, ``l:`` its labels, ``p:`` the path's words without digits."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.when(
        F.size(labels) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(labels) - 1),
            lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^a-z]+"), lambda x: x != "")
    return F.array_distinct(F.concat(
        suffixes, F.transform(labels, lambda x: F.concat(F.lit("l:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
    ))


def mine_rules(labelled: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """rule_id, items (arrays of equivalent tokens), confidence, support, from labelled pages (host, path, bad).

    FP-growth finds the frequent item combinations with the label as one more
    item; of its rules that conclude "bad" those above the thresholds stay,
    and of these a rule with a part that is as confident on its own is dropped.
    """
    spark = labelled.sparkSession
    rows = materialise(
        labelled.select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
        .filter("size(tokens) > 0 OR bad"),
        "labelled-urls",
    )
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    least = max(params.min_count, math.ceil(params.min_support * n))
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    items = materialise(
        held.groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bads"),
            F.bit_xor(F.xxhash64("row")).alias("f"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("g"),
        ).filter(F.col("bads") >= least).groupBy("n", "f", "g").agg(F.array_sort(F.collect_list("token")).alias("same"))
        .select(F.get("same", 0).alias("item"), "same"),
        "url-items",
    )
    baskets = held.join(items.select("item", F.explode("same").alias("token")), "token").groupBy("row").agg(F.collect_set("item").alias("own"))
    merged = materialise(
        rows.select("row", "bad").join(baskets, "row", "left").select(
            F.concat(F.coalesce("own", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
        ).filter(F.size("items") > 0),
        "url-baskets",
    )
    m = merged.count()
    model = FPGrowth(
        itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(m, 1)), minConfidence=params.min_confidence, numPartitions=shuffle_partitions(spark),
    ).fit(merged)
    good, base = 1 - n_bad / max(n, 1), max(n_bad, 1) / max(n, 1)
    convinces = (1 - F.col("confidence")) * params.min_conviction <= good + 1e-12
    found = (
        model.associationRules.filter(
            (F.size("consequent") == 1) & (F.get("consequent", 0) == BAD)
            & ((F.col("confidence") / base >= params.min_lift) | F.lit(n_bad * 2 > n) & convinces) & (F.round(F.col("support") * m) >= least)
        ).select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * m / max(n, 1)).alias("support"))
    )
    found = materialise(found.withColumn("rule_id", F.xxhash64(F.array_join("tokens", " "))), "mined-rules")
    # A shorter rule within a longer one, found by its parts: first those that lack one token, which
    # leaves few long rules, then all others.
    best = _undominated(_undominated(found, found, _parts_by_one), found, _proper_parts)
    rules = materialise(
        best.select("rule_id", "confidence", "support", F.explode("tokens").alias("item")).join(items, "item")
        .groupBy("rule_id", "confidence", "support").agg(F.array_sort(F.collect_list("same")).alias("items")),
        "url-rules",
    )
    release(rows, items, merged, found)
    return rules


def _undominated(rules: DataFrame, found: DataFrame, parts_of: Callable[[Column], Column]) -> DataFrame:
    """The rules without a part among ``found`` that is as confident on its own."""
    parts = rules.select("rule_id", "confidence", F.explode(parts_of(F.col("tokens"))).alias("part"))
    better = (
        parts.alias("a").join(found.alias("b"), F.xxhash64(F.array_join("a.part", " ")) == F.col("b.rule_id"))
        .filter("b.confidence >= a.confidence").select("a.rule_id").distinct()
    )
    return rules.join(better, "rule_id", "left_anti")


def _parts_by_one(tokens: Column) -> Column:
    """The non-empty sub-arrays that lack one token."""
    parts = F.transform(tokens, lambda t: F.filter(tokens, lambda x: x != t))
    return F.filter(parts, lambda x: F.size(x) > 0)


def _proper_parts(tokens: Column) -> Column:
    """All non-empty proper sub-arrays of a sorted array."""
    n = F.size(tokens)
    masks = F.filter(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), n).cast("long") - 1), lambda m: m < F.pow(F.lit(2), n).cast("long") - 1)
    return F.transform(
        masks,
        lambda m: F.filter(tokens, lambda x, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0),
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined_rule of the URLs (url, host, path) that a mined rule fits: the
    most confident one, of equals the one with the smallest tokens.

    Inverted index: every rule stands under the tokens of its rarest item (by
    the URLs that hold them), so a token that most URLs hold calls up few rules.
    """
    tokens = urls.select("url", url_tokens(F.col("host"), F.col("path")).alias("own"))
    postings = tokens.select("url", "own", F.explode("own").alias("token"))
    used = rules.select("rule_id", F.posexplode("items").alias("place", "same")).select("rule_id", "place", F.explode("same").alias("token"))
    held = postings.join(used.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        used.join(held, "token", "left").groupBy("rule_id", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        .groupBy("rule_id").agg(F.min(F.struct("n", "place"))["place"].alias("place"))
    )
    index = used.join(rarest, ["rule_id", "place"]).select("rule_id", "token").join(rules.select("rule_id", "items", "confidence"), "rule_id")
    hits = postings.join(index, "token").filter(F.forall("items", lambda x: F.arrays_overlap(x, F.col("own"))))
    shown = F.array_join(F.array_sort(F.transform("items", lambda x: F.array_min(F.array_intersect(x, F.col("own"))))), " ")
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), shown.alias("mined_rule"))).alias("best"))
    return best.select("url", "best.mined_rule")


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], params: MiningParams = MiningParams()
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every page.

    The verdict is the longest listed rule's; without one it is ``block`` where
    a mined rule fits the URL and ``allow`` where none does (also for a null
    URL, whose host and path are empty). Labels are (doc_id, quality, toxic) of
    pages by page_id; a page is bad when a label calls it toxic or of quality
    0, and labels without a page, or null, teach nothing. Pages repeated give
    repeated rows. Without labels nothing is mined. URLs are judged once each,
    however many pages share them.
    """
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).filter("bad IS NOT NULL")
    labelled = cut.join(judged, F.col("page_id") == F.col("doc_id")).select("host", "path", "bad")
    mined = mine_rules(labelled, params)
    urls = cut.filter("url IS NOT NULL").select("url", "host", "path").distinct()
    # A written table on both sides lets adaptive execution split a URL that very many pages share; null URLs fit no mined rule.
    fits = materialise(match_rules(urls, mined), "url-fits")
    cut = cut.withColumn("rule", rule).withColumn("listed", verdict)
    none = cut.filter("url IS NULL").withColumn("mined_rule", F.lit(None).cast("string"))
    out = cut.filter("url IS NOT NULL").join(fits, "url", "left").unionByName(none)
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
    )
