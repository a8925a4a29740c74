"""URL filters: hand rules first, then mined association rules.

A URL becomes a set of tokens (host labels, path segments, query names, ...).
Labelled pages add their label as one more token, and Spark's FP-growth mines
the rules ``tokens -> blocked``.  Rules are pruned by support and confidence,
and a rule is dropped if a part of its tokens predicts as well.  Rules match by
an inverted index: each is listed under its rarest token, a page looks up its
own tokens there, and the remaining tokens of the rules found are checked.

Hand rules are (host, path) pairs with a verdict.  One fits its host and all
subdomains if the path starts with the rule's; the longest wins.  Where none
fits, a page is blocked if a mined rule matches, else allowed.

A null url, or one without ``://``, has an empty host and path and no tokens; it
is allowed.  Repeated rows get equal results.  A page without labels teaches
nothing; of several labels of a page any bad one counts.  Without labels or rules
the mined part allows all.  Extra columns are ignored.  Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import write_table

# Fixed values of the query contract.
HAND_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_PAGES = 0.001, 0.6, 10
BLOCKED = "label:blocked"


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lowered; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def hand_rule(rules=HAND_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule over columns host and path."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL; digits become ``#`` so that numbers meet."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^?#]*\??([^#]*)", 1)

    def tagged(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind + ":"), F.regexp_replace(p, "[0-9]+", "#")))

    names = F.transform(F.split(rest, "&"), lambda p: F.substring_index(p, "=", 1))
    # words of a host label only where they are not the label itself: such twins always occur together
    joined = F.filter(F.split(F.col("host"), r"\."), lambda p: p.rlike("[-_]"))
    words = F.concat(tagged("host", F.split(F.col("host"), r"\.")), tagged("hostword", F.flatten(F.transform(joined, lambda p: F.split(p, "[-_]")))),
                     tagged("path", F.split(F.col("path"), "/")), tagged("query", names))
    return F.array_distinct(F.when(F.col("host") != "", words).otherwise(F.array().cast("array<string>")))


def judged_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, tokens; one row per distinct page and url."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).distinct()
    return rows.select("*", host_of().alias("host"), path_of().alias("path")).select("*", url_tokens().alias("tokens"))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Pruned rules: rule_id, antecedent, confidence, support.

    ``pages`` has page_id and tokens; ``labels`` has page_id and blocked.
    """
    known = labels.where(F.col("blocked").isNotNull()).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    baskets = pages.join(known, "page_id").where(F.size("tokens") > 0).select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    baskets = write_table(baskets, "url_baskets")
    n = baskets.count()
    support = max(min_support, min_pages / n) if n else 1.0
    empty = "rule_id long, antecedent array<string>, confidence double, support double"
    if n == 0 or support > 1:
        return pages.sparkSession.createDataFrame([], empty)
    # the label is kept only in the transactions that have it, so rules end in it
    mined = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets).associationRules
    mined = write_table(mined.where(F.col("consequent")[0] == BLOCKED).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url_rules")
    numbered = mined.withColumn("rule_id", F.xxhash64(F.array_join("antecedent", "\x00")))
    # a shorter rule within a rule makes it needless if it is as sure
    parts = numbered.select(F.col("rule_id").alias("p_id"), F.col("antecedent").alias("p"), F.col("confidence").alias("p_conf"),
                            F.element_at("antecedent", 1).alias("p_first"))
    opened = numbered.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("item"))
    beaten = opened.join(parts, F.col("item") == F.col("p_first")).where(
        (F.size("p") < F.size("antecedent")) & (F.size(F.array_except("p", "antecedent")) == 0) & (F.col("p_conf") >= F.col("confidence")))
    return numbered.join(beaten.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, confidence): the surest rule of each page that any matches."""
    opened = pages.select("page_id", "url", "tokens", F.explode("tokens").alias("token"))
    counts = opened.groupBy("token").agg(F.count("*").alias("n"))
    listed = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    # the rarest token of a rule is its place in the index
    index = listed.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("least"),
        F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence"))
    index = write_table(index.select(F.col("least.token").alias("at"), "antecedent", "confidence"), "url_index")
    met = opened.join(index, F.col("token") == F.col("at")).where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("page_id", "url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=HAND_RULES, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence (of the mined rule)."""
    distinct = write_table(judged_pages(pages, id_col, url_col), "url_pages")
    mined = match_rules(distinct, mine_rules(distinct, labels, **how))
    mined = mined.withColumnsRenamed({"page_id": "m_id", "url": "m_url"})
    rule, verdict = hand_rule(rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.join(mined, F.col("page_id").eqNullSafe(F.col("m_id")) & F.col("url").eqNullSafe(F.col("m_url")), "left")
    rows = rows.select("page_id", host_of().alias("host"), path_of().alias("path"), "confidence")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "confidence")
