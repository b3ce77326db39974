"""URL filter: host and path rules, then a character language-model ratio for what no rule judges.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.skew import hot_counts, salted_join
from spikeloom.session import checkpoint

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER, PRIOR = 4, 2.0
TASK_GRAMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\u0002"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for does, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(does)).otherwise(verdict)
    return name, verdict


def grams(url: Column, order: int) -> Column:
    """Every character of the URL with the ``order`` characters before it; START stands before the first."""
    padded = F.concat(F.lit(START * order), url)
    n = F.length(url)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(order + 1))))


def ratios(grams_: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(gram, ratio): log-likelihood difference, accepted less rejected, of a gram's last character.

    ``grams_(gram, good, bad)`` counts the longest grams of all URLs by class.  Shorter contexts are
    sums of longer ones.  Each order's probability is its count plus ``prior`` times that of the
    next shorter context (variable order: a context never seen leaves the shorter one's estimate).
    """
    classes = ("good", "bad")
    level = {order: grams_}
    for k in range(order - 1, -1, -1):
        level[k] = level[k + 1].withColumn("gram", F.substring("gram", 2, k + 1)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in classes])
    total = level[0].agg(*[F.sum(c).alias(c) for c in classes], F.count(F.lit(1)).alias("n"))
    row = {c: total.select(c).scalar() for c in (*classes, "n")}
    p = level[0].select("gram", *[((F.col(c) + prior / row["n"]) / (row[c] + prior)).alias(f"p_{c}") for c in classes])
    for k in range(1, order + 1):
        now = level[k].withColumn("ctx", F.substring("gram", 1, k)).withColumn("tail", F.substring("gram", 2, k))
        sums = now.groupBy("ctx").agg(*[F.sum(c).alias(f"n_{c}") for c in classes])
        short = p.toDF("tail", *[f"q_{c}" for c in classes])
        # A context or tail has at most one row a character: no key is hot.
        now = now.join(sums, "ctx").join(short, "tail")
        p = now.select("gram", *[((F.col(c) + prior * F.col(f"q_{c}")) / (F.col(f"n_{c}") + prior)).alias(f"p_{c}") for c in classes])
    return p.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER, min_good: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's ``score`` and ``good`` for every page.

    URLs that a rule allows or blocks are the examples.  Four fifths of them, by hash of the URL,
    are counted; the last fifth calibrates: class means and the common variance of the score, the
    log-likelihood difference a character, give the probability of an allowed URL.  A page without a
    rule is allowed if that is at least ``min_good``.  Each distinct URL is scored once.

    Null, empty and malformed URLs have no rule; a null or empty one, and every one when examples
    of a class are missing, is allowed with ``good`` 1.  Repeated rows are judged alike.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(host, path, rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("said"))

    one = checkpoint(rows.where(F.length("url") > 0).groupBy("url").agg(F.first("said").alias("said"), F.count(F.lit(1)).alias("_n")))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    good, bad = ((F.col("said") == c) & ~held for c in ("allow", "block"))
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    # A URL becomes about as many rows as it has letters: the number of tasks follows those, not the few bytes of the URLs.
    letters = one.agg(F.sum(F.length("url"))).first()[0] or 0
    spread = one.repartition(max(1, letters // TASK_GRAMS)).select("url", "said", F.explode(grams(F.translate("url", UPPER, LOWER), order)).alias("gram"), flag(good).alias("good"), flag(bad).alias("bad"))
    tally = checkpoint(spread.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("_n")))
    table = checkpoint(ratios(tally.select("gram", "good", "bad"), order))

    scored = salted_join(spread.select("url", "said", "gram"), table, ["gram"], F.col("url"), hot=hot_counts(tally.select("gram", "_n"), ["gram"]))
    scored = checkpoint(scored.groupBy("url").agg(F.avg("ratio").alias("score"), F.first("said").alias("said")))
    on = lambda c: F.when(F.col("said") == c, F.col("score"))
    seen = scored.where(held).agg(*[f(on(c)).alias(f"{n}_{c}") for c in ("allow", "block") for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))]).first()
    if seen["n_allow"] and seen["n_block"]:
        n = seen["n_allow"] + seen["n_block"]
        var = max(1e-6, (seen["n_allow"] * seen["v_allow"] + seen["n_block"] * seen["v_block"]) / n)
        slope = (seen["m_allow"] - seen["m_block"]) / var
        logit = F.lit(slope) * (F.col("score") - F.lit((seen["m_allow"] + seen["m_block"]) / 2))
        sure = 1 / (1 + F.exp(-logit))
    else:
        sure = F.lit(1.0)
    back = salted_join(rows, scored.select("url", "score", sure.alias("good")), ["url"], F.col("page_id"), "left", hot=hot_counts(one.select("url", "_n"), ["url"]))
    model = F.when(F.coalesce("good", F.lit(1.0)) >= min_good, "allow").otherwise("block")
    return back.select("page_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"), "score", F.coalesce("good", F.lit(1.0)).alias("good"))

