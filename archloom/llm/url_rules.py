"""URL filters: fixed host and path rules, and token combinations that FP-growth mines from labels."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.sources.scratch import Scratch

#: (verdict, host, path). The longest that fits decides.
FIXED_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: labels of the host, words of the path, keys of the query."""
    query = F.coalesce(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.split(path, "[/_.-]+"), lambda x: F.concat(F.lit("path="), x))
    return F.array_distinct(F.filter(F.concat(labels, parts, keys), lambda x: ~x.endswith("=")))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host, all subdomains, and paths that begin as its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def token_groups(tokens: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(token, item, n_block, n_all) of the tokens in ``least`` pages to block or more; ``item`` stands for all tokens of the same pages.

    ``tokens``: page, block, token. The set of a token's pages is compared by its size and a sum of
    hashes, which combines before the shuffle.
    """
    mark = lambda seed: F.sum(F.xxhash64("page", F.lit(seed)).cast("decimal(38,0)"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n_all"), F.sum(F.col("block").cast("long")).alias("n_block"), mark(1).alias("m1"), mark(2).alias("m2"))
    counts = scratch.keep(counts.where(F.col("n_block") >= least))
    same = ["n_all", "n_block", "m1", "m2"]
    heads = counts.groupBy(*same).agg(F.min("token").alias("item"))
    return scratch.keep(counts.join(heads, same).select("token", "item", "n_block", "n_all"))


def live_pairs(items: DataFrame, singles: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(a, b, n_block, n_all, live) of the pairs a < b of items in ``least`` pages to block or more.

    live: neither item implies the other. A pair of which one does has the pages of a single item, so no
    minimal rule holds both.
    """
    pair = items.select("page", "block", F.col("item").alias("a")).join(items.select("page", F.col("item").alias("b")), "page").where("a < b")
    found = pair.groupBy("a", "b").agg(F.count("*").alias("n_all"), F.sum(F.col("block").cast("long")).alias("n_block")).where(F.col("n_block") >= least)
    n = singles.select("item", F.col("n_all").alias("n"))
    found = found.join(n.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    return scratch.keep(found.select("a", "b", "n_block", "n_all", (F.col("n_all") < F.least("n_a", "n_b")).alias("live")))


def without_supersets(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rules (antecedent) those that hold no other whole, from the smallest on; by the tokens that two rules share."""
    kept = found.limit(0)
    sizes = sorted(r[0] for r in found.select(F.size("antecedent")).distinct().collect())  # a few numbers
    for size in sizes:
        now = found.where(F.size("antecedent") == size)
        shared = now.select(F.col("rule_id").alias("own"), F.explode("antecedent").alias("t")).join(kept.select(F.col("rule_id").alias("part"), F.size("antecedent").alias("need"), F.explode("antecedent").alias("t")), "t")
        whole = shared.groupBy("own", "part", "need").agg(F.count("*").alias("n")).where("n = need").select(F.col("own").alias("rule_id")).distinct()
        kept = scratch.keep(kept.unionByName(now.join(whole, "rule_id", "left_anti")))
    return kept


def mine_rules(labelled: DataFrame, scratch: Scratch, *, min_support: float, min_confidence: float, min_pages: int = 1) -> DataFrame:
    """(rule_id, antecedent array<array<string>>, confidence, support) of the minimal rules ``tokens -> block``.

    An antecedent is met by a page that holds a token of each of its groups: those of a group stand in the same pages of
    ``labelled``, so a rule of one of them is as good with any other, and elsewhere they may stand alone.

    ``labelled``: tokens array<string>, block boolean. The pages with a rule's tokens and to block are at least ``min_support`` of all
    and ``min_pages``, and ``min_confidence`` of those with its tokens. A rule that holds
    another one whole matches nothing more and goes, level by level: tokens that are rules alone are
    not mined on, nor are pairs, nor tokens of which no pair could become a rule; tokens that always
    stand together are one item. FP-growth gets what is left, so a url of hundreds of tokens that stand
    and fall together costs no more than a short one. (m items in one page of which every two occur with
    and without each other have 2**m combinations, as in any mining of itemsets.)
    """
    rows = scratch.keep(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("page"), "block", "tokens"))
    total = labelled.count()
    least = max(1, min_pages, math.ceil(Fraction(str(min_support)) * total))  # 0.07 * 100 is above 7 in doubles
    tokens = rows.select("page", "block", F.explode("tokens").alias("token"))
    groups = token_groups(tokens, scratch, least)
    singles = groups.where("token = item").select("item", "n_block", "n_all")
    sure = lambda n, of: n.cast("double") / of >= min_confidence
    one = singles.where(sure(F.col("n_block"), F.col("n_all"))).select(F.array("item").alias("antecedent"), "n_block", "n_all")
    rest = singles.where(~sure(F.col("n_block"), F.col("n_all")))
    items = scratch.keep(tokens.join(groups.where("token = item").select("token"), "token").join(rest.select(F.col("item").alias("token")), "token", "left_semi").select("page", "block", F.col("token").alias("item")))
    pairs = live_pairs(items, rest, scratch, least)
    two = pairs.where(F.col("live") & sure(F.col("n_block"), F.col("n_all"))).select(F.array("a", "b").alias("antecedent"), "n_block", "n_all")
    # triples and more: of items that have two open partners
    open_ = pairs.where(F.col("live") & ~sure(F.col("n_block"), F.col("n_all")))
    partners = open_.select(F.col("a").alias("item")).unionByName(open_.select(F.col("b").alias("item"))).groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select("item")
    baskets = scratch.keep(items.join(partners, "item", "left_semi").groupBy("page").agg(F.max("block").alias("block"), F.collect_list("item").alias("items")).where(F.size("items") > 2))
    mined = baskets.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    size = mined.count()
    if size >= least:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), minConfidence=min_confidence).fit(mined)
        more = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.size("antecedent") > 2))
        n_block = F.round(F.col("support") * size).cast("long")
        more = more.select(F.array_sort("antecedent").alias("antecedent"), n_block.alias("n_block"), F.round(n_block / F.col("confidence")).cast("long").alias("n_all"))
        two = two.unionByName(more)
    found = scratch.keep(one.unionByName(two).select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", (F.col("n_block") / F.col("n_all")).alias("confidence"), (F.col("n_block") / F.lit(total)).alias("support")))
    kept = without_supersets(found, scratch)
    alike = kept.select("rule_id", "confidence", "support", F.explode("antecedent").alias("item")).join(groups.select("item", "token"), "item")
    alike = alike.groupBy("rule_id", "confidence", "support", "item").agg(F.collect_set("token").alias("tokens"))
    return alike.groupBy("rule_id", "confidence", "support").agg(F.collect_list("tokens").alias("antecedent"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_key) of the pages that hold a token of each group of some rule.

    Inverted index: each rule stands under the tokens of its rarest group alone, so a page meets few rules, and
    tokens that all pages share lead to none; the other groups are then looked for in the page.
    ``pages``: page_key, tokens.
    """
    counts = pages.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    used = rules.select("rule_id", "antecedent", F.posexplode("antecedent").alias("group", "tokens"))
    found = used.select("rule_id", "group", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule_id", "group").agg(F.sum("n").alias("n"))
    rarest = found.groupBy("rule_id").agg(F.min_by("group", F.struct("n", "group")).alias("group"))
    index = used.join(rarest, ["rule_id", "group"]).select("rule_id", "antecedent", F.explode("tokens").alias("token"))
    entries = pages.select("page_key", "tokens", F.explode("tokens").alias("token"))
    hit = entries.join(index, "token").where(F.forall("antecedent", lambda group: F.arrays_overlap(group, F.col("tokens"))))
    return hit.select("page_key").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", fixed=FIXED_RULES, min_support: float = 0.002, min_confidence: float = 0.5, min_pages: int = 5) -> DataFrame:
    """One row for each row of ``pages``: (id, host, path, rule, verdict, mined boolean).

    ``labels``: doc_id, quality, toxic; a page whose label (same id) is toxic or of quality 0 counts
    as one to block. The longest fixed rule decides; else a url with a mined token combination is
    blocked, and any other allowed. A combination in fewer than ``min_pages`` labelled pages to block is no rule,
    whatever its share. Without labels nothing is mined. Null urls have empty host and
    path and are allowed. Rows with one id but different urls are judged each for itself.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col).cast("string")
    read = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), url_host(url).alias("host"), url_path(url).alias("path"))
    tokens = F.coalesce(url_tokens(F.coalesce("_url", F.lit("")), F.col("host"), F.col("path")), F.array().cast("array<string>"))
    read = scratch.keep(read.select("_id", "host", "path", tokens.alias("tokens"), F.xxhash64("_url").alias("page_key")))
    said = labels.select(F.col("doc_id").alias("_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("block"))
    said = said.where("_id is not null").groupBy("_id").agg(F.max("block").alias("block"))
    rules = mine_rules(read.join(said, "_id").select("tokens", "block"), scratch, min_support=min_support, min_confidence=min_confidence, min_pages=min_pages)
    # equal urls are matched once
    hit = match_rules(read.select("page_key", "tokens").groupBy("page_key").agg(F.min("tokens").alias("tokens")), scratch.keep(rules)).withColumn("mined", F.lit(True))
    out = read.join(hit, "page_key", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
