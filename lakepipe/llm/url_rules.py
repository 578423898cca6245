"""URL filters by association rules, in DataFrame operations and Spark's FP-growth.

A URL is a set of tokens: its host's labels, its path segments, the ending of the last one, its parameters (names, and names
with values) and whether it has a fragment. FP-growth finds the token combinations that are frequent among labelled URLs
together with their label; rules "these tokens, so this label" are pruned by confidence, by support (a share and a number of
URLs), by lift (how much surer they are than the label's share of all), and by any part of them that says the same at least
as surely. Rules are indexed by token; a URL meets those of its tokens, and a rule applies if it met it by all of its
tokens. URLs are matched by their set of frequent tokens, once for each different set. The surest rule decides, then the one
with more support, then the first by its text.

A list of fixed rules comes before: ``host/path`` fits its host and all subdomains of it where the URL's path starts with
the rule's; the longest decides. URLs that a fixed rule decides are the labelled ones.

Defined results: a URL that is null or has no ``://`` has an empty host and path, and is allowed. URLs that no rule decides
are allowed, also if there are no labels at all. Rows that are alike get like results. No rows: no rows. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label:"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fixed(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The rule that decides and its verdict, null if none does. ``rules``: (verdict, ``host/path``)."""
    rule = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        h, slash, p = text.partition("/")
        hit = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(slash + p)
        rule, verdict = F.when(hit, text).otherwise(rule), F.when(hit, say).otherwise(verdict)
    return rule, verdict


def tokens(url: str, host: str = "host", path: str = "path") -> Column:
    marked = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    ending = F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.split(F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1), "&")
    single = F.array(
        F.when(ending != "", F.concat(F.lit("ending:"), ending)),
        F.when(F.instr(F.col(url), "#") > 0, F.lit("fragment")),
    )
    found = F.concat(
        marked("host:", F.split(F.col(host), r"\.")),
        marked("path:", F.split(F.col(path), "/")),
        marked("query:", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
        marked("query:", F.filter(query, lambda x: F.instr(x, "=") > 1)),
        single,
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def mine(labelled: DataFrame, least_support: float = 0.01, least_confidence: float = 0.8, least_rows: int = 10, least_lift: float = 1.2) -> DataFrame:
    """``labelled``: tokens and verdict. Gives rules: rule (a text), tokens, verdict, confidence, support.

    A rule's tokens and verdict are together on ``least_support`` of all URLs and on ``least_rows`` at least. The number of
    frequent tokens is at most the mean number of tokens over ``least_support``, whatever the corpus.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    schema = "rule string, tokens array<string>, verdict string, confidence double, support double"
    n = baskets.count()
    if n < least_rows or not n:
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=max(least_support, (least_rows - 0.5) / n), minConfidence=least_confidence).fit(baskets).associationRules
    says = F.col("consequent")[0]
    rules = found.where(says.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)) & (F.col("lift") >= least_lift - 1e-9))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(says, len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support")
    rules = written(rules.withColumn("rule", F.array_join("tokens", " ")).select(*[c.split()[0] for c in schema.split(", ")]), "rules")
    # a rule goes if a part of it says the same as surely; the parts are met through a token that both have
    part = rules.select(F.col("tokens").alias("t2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"), F.explode("tokens").alias("token"))
    whole = rules.select("rule", "tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    covered = whole.join(part, (whole["token"] == part["token"]) & (F.col("verdict") == F.col("v2")) & (F.col("c2") >= F.col("confidence")) & (F.size("t2") < F.size("tokens")) & (F.size(F.array_except("t2", "tokens")) == 0), "left_semi")
    return rules.join(covered.select("rule", "verdict").distinct(), ["rule", "verdict"], "left_anti").select(*[c.split()[0] for c in schema.split(", ")])


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with tokens) and ``learned``: the verdict of the rule that decides, null if none applies."""
    index = rules.select("rule", "verdict", "confidence", "support", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    known = written(index.select("token").distinct(), "tokens")
    frequent = known.agg(F.array_sort(F.collect_list("token")).alias("all"))
    keyed = urls.withColumn("__set", F.array_intersect("tokens", F.coalesce(frequent.scalar(), F.array().cast("array<string>"))))
    sets = written(keyed.select("__set").where(F.size("__set") > 0).distinct(), "sets")
    met = sets.withColumn("token", F.explode("__set")).join(index, "token").groupBy("__set", "rule", "verdict", "confidence", "support", "need").agg(F.count(F.lit(1)).alias("n"))
    best = met.where("n = need").groupBy("__set").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule", "verdict")).alias("b"))
    # a set that very many URLs have is dealt to as many tasks as there are
    salts = partitions(urls.sparkSession)
    best = best.select("__set", F.col("b.verdict").alias("learned"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
    return salted.join(best, ["__set", "__salt"], "left").drop("__set", "__salt")


def judge(pages: DataFrame, rules: list[tuple[str, str]], least_support: float = 0.01, least_confidence: float = 0.8, least_rows: int = 10, least_lift: float = 1.2, page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (the fixed rule that decides, else null), verdict (allow or block)."""
    rows = pages.select(F.col(page_id).alias("page_id"), "url")
    host, path = host_and_path("url")
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("tokens", tokens("url"))
    rule, verdict = fixed(rules)
    rows = written(rows.withColumn("rule", rule).withColumn("fixed", verdict), "urls")
    learned = mine(rows.where("fixed IS NOT NULL").select("tokens", F.col("fixed").alias("verdict")), least_support, least_confidence, least_rows, least_lift)
    out = match(rows, written(learned, "rules"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "learned", F.lit("allow")).alias("verdict"))
