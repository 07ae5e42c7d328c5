"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

URLs that a rule allows or blocks teach two variable-order Markov models of characters, smoothed by
Witten-Bell interpolation from order ``ORDER`` down to a uniform distribution. A URL without rule is
judged by the difference of its two log-likelihoods per character. The limit is calibrated on a fold
of the URLs with rules that the models have not seen: it lies equally many standard
deviations from either class.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is
judged by the model on what text there is; if only one class teaches, it is every other URL's
verdict, and without any the verdict is allow; repeated rows and ids are judged alike and all
returned; an empty table gives no rows; URLs of any length are judged whole; other columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmart.llm.scratch import join_frequent, saved

# The rules; each names a host with all its subdomains, and where paths begin.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
ORDER = 4
# One fold in so many calibrates.
FOLDS = 5
# Grams with over one in so many of all places are looked up in place; there cannot be more.
FREQUENT_GRAMS = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BEGIN, _END = "\x02", "\x03"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(
            path, F.lit(slash + start)
        )
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def _grams(text: Column, order: int) -> Column:
    """Each character, and the end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(_BEGIN * order), text, F.lit(_END))
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return F.transform(places, lambda i: padded.substr(i, F.lit(order + 1)))


def gram_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio`` from ``gram, a, b``: how often accepted and rejected URLs contain it.

    ``ratio`` is the difference of the logs of the two models' probabilities of the last character
    given those before it.
    """
    grams = saved(grams)
    characters = grams.select(F.substring("gram", order + 1, 1).alias("c")).distinct()
    symbols = max(1, characters.count())
    lower = None
    for k in range(order + 1):
        gram = F.substring(F.col("gram"), order + 1 - k, k + 1)
        level = grams.groupBy(gram.alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substring(F.col("gram"), 1, k)
        totals = level.groupBy(context.alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"),
        )
        level = level.withColumn("context", context).join(totals, "context")
        if lower is None:
            level = level.withColumns({"la": F.lit(1.0 / symbols), "lb": F.lit(1.0 / symbols)})
        else:
            shorter = lower.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"),
                                   F.col("pb").alias("lb"))
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(shorter, "shorter")
        lower = level.select(
            "gram",
            _interpolated("a", "na", "ta", "la").alias("pa"),
            _interpolated("b", "nb", "tb", "lb").alias("pb"),
        )
        lower = saved(lower)
    return lower.select("gram", (F.ln("pa") - F.ln("pb")).alias("ratio"))


def _interpolated(n: str, total: str, types: str, lower: str) -> Column:
    whole = F.col(total) + F.col(types)
    mixed = (F.col(n) + F.col(types) * F.col(lower)) / whole
    return F.when(whole > 0, mixed).otherwise(F.col(lower))


def judge_urls(
    df: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    *,
    rules: Sequence[tuple[str, str]] = RULES,
    order: int = ORDER,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio, threshold`` for every row.

    ``ratio`` is the difference of log-likelihoods per character, for URLs with rules too.
    """
    url = F.col(url_column)
    pages = df.select(F.col(id_column).alias("page_id"), url.alias("url")).select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        lower_ascii(F.coalesce(_after_scheme(F.col("url")), F.col("url"), F.lit(""))).alias("text"),
    )
    found = rule_of(F.col("host"), F.col("path"), rules)
    pages = saved(
        pages.withColumn("found", found).select(
            "row", "page_id", "host", "path", "text", F.col("found.rule").alias("rule"),
            F.col("found.verdict").alias("given"),
            (F.crc32(F.col("text").cast("binary")) % FOLDS == 0).alias("calibrates"),
        )
    )
    grams = pages.select(
        "row",
        F.coalesce((F.col("given") == "allow") & ~F.col("calibrates"), F.lit(False)).alias("a"),
        F.coalesce((F.col("given") == "block") & ~F.col("calibrates"), F.lit(False)).alias("b"),
        F.explode(_grams(F.col("text"), order)).alias("gram"),
    )
    counts = saved(
        grams.groupBy("gram").agg(
            F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count("*").alias("n")
        )
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    ratios = saved(gram_ratios(counts.select("gram", "a", "b"), order).join(
        counts.select("gram", "n"), "gram"
    ))
    # Some grams, such as those of a common ending of hosts, are in most URLs.
    often = F.col("n") * FREQUENT_GRAMS > total
    scores = (
        join_frequent(grams.select("row", "gram"), ratios, ["gram"], often)
        .groupBy("row").agg(F.avg("ratio").alias("ratio"))
    )
    judged = saved(pages.drop("text").join(scores, "row"))
    threshold, only = _calibrated(judged)
    by_model = (
        F.lit(only)
        if only
        else F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    )
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("given", by_model).alias("verdict"), "ratio", F.lit(threshold).alias("threshold"),
    )


def _calibrated(judged: DataFrame) -> tuple[float, str | None]:
    """The limit of the ratio, and the verdict if only one class, or none, teaches."""
    rows = {
        (row["given"], row["calibrates"]): row
        for row in judged.filter("given IS NOT NULL")
        .groupBy("given", "calibrates")
        .agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread"))
        .collect()
    }
    taught = [given for given in ("allow", "block") if (given, False) in rows]
    if len(taught) < 2:
        return 0.0, taught[0] if taught else "allow"
    allow, block = rows.get(("allow", True)), rows.get(("block", True))
    if allow is None or block is None:
        return 0.0, None
    spread = allow["spread"] + block["spread"]
    if not spread:
        return (allow["mean"] + block["mean"]) / 2, None
    share = allow["mean"] * block["spread"] + block["mean"] * allow["spread"]
    return share / spread, None
