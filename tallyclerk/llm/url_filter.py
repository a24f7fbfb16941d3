"""URL filters: pattern rules found through their rarest literal token.

A rule is either a domain rule (a host, all its subdomains, and a path prefix) or a pattern in the
common filter-list notation: `*` any run, `^` a separator or the end, `||` the start of a host
label, `|` an end of the URL. Each rule is indexed by the literal token that is rarest among the
URLs at hand; the tokens of a URL fetch candidate rules, and only for those a regular expression
runs. Everything is DataFrame functions; no Python runs on the executors.

Results for odd input: a null URL and one without `://` have empty host and path and get the
default verdict unless a pattern fits; repeated rows each get their verdict; an empty table gives
an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii

#: Domain rules: (action, host, path). The longest fitting one decides before any pattern.
DOMAIN_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Patterns: (action, pattern). An allowing pattern outranks a blocking one.
PATTERN_RULES = [
    ("block", "||spam-farm."),
    ("block", "||adult-x."),
    ("block", "://*casino*."),
    ("block", "/wp-login.php^"),
    ("block", "/click-track/"),
    ("block", "||doubleclick.net^"),
    ("block", "&affiliate_id="),
    ("allow", "||example.org/robots.txt|"),
]
RULE_SCHEMA = "action string, host string, path string, pattern string"
TOKEN, OPEN = "[a-z0-9]+", "\x01"
#: Rule indexes of up to this many rows (some 100 MB) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(a, h, p, None) for a, h, p in DOMAIN_RULES] + [(a, None, None, p) for a, p in PATTERN_RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+?{}()\[\]$|*^])", r"\\$1")


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their name, the expression that decides, and the tokens a fitting URL must have."""
    domain = F.col("host").isNotNull()
    host, path = F.coalesce(lower_ascii("host"), F.lit("")), F.coalesce("path", F.lit(""))
    name = F.when(domain, F.concat(host, path)).otherwise(F.col("pattern"))
    for_domain = F.concat(F.lit(r"^(?:[^/]*\.)?"), _literal(host), F.when(path == "", F.lit("(?:/|$)")).otherwise(_literal(path)))
    text = lower_ascii("pattern")
    inner = F.regexp_replace(F.regexp_replace(text, r"^\|\|?", ""), r"\|$", "")
    inner = F.regexp_replace(inner, r"([\\.+?{}()\[\]$|])", r"\\$1")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\*+", ".*"), r"\^", r"(?:[^a-z0-9_.%-]|\$)")
    front = F.when(text.startswith("||"), F.lit(r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?")).when(text.startswith("|"), F.lit("^")).otherwise(F.lit(""))
    for_pattern = F.concat(F.lit("(?s)"), front, inner, F.when(F.regexp_like(text, F.lit(r".\|$")), F.lit("$")).otherwise(F.lit("")))
    # A token counts only where something that is no token character is sure to stand on both
    # sides; OPEN marks the places where anything may follow.
    bounded = F.when(domain, F.concat(F.lit("."), host, F.lit("/"), lower_ascii(path), F.lit(OPEN))).otherwise(
        F.concat(
            F.when(text.startswith("|"), F.lit("|")).otherwise(F.lit(OPEN)),
            F.replace(text, F.lit("*"), F.lit(OPEN)),
            F.when(F.regexp_like(text, F.lit(r"[|^]$")), F.lit("|")).otherwise(F.lit(OPEN)),
        )
    )
    tokens = F.regexp_extract_all(bounded, F.lit(f"(?<![a-z0-9{OPEN}])({TOKEN})(?![a-z0-9{OPEN}])"), 1)
    return rules.select(
        name.alias("rule"), "action", domain.alias("is_domain"), F.when(domain, for_domain).otherwise(for_pattern).alias("expression"),
        F.array_distinct(tokens).alias("tokens"),
    ).filter("rule IS NOT NULL").distinct()


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; the empty one fetches the rules that have no token."""
    found = F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules keyed by that of their tokens which the fewest URLs hold."""
    ready = compiled(rules)
    wanted = ready.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(broadcast_if_small(wanted, BROADCAST_ROWS), "token")
    counts = wanted.join(seen.groupBy("token").agg(F.count("*").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = (
        ready.select("rule", "expression", F.explode("tokens").alias("token")).join(counts, "token")
        .groupBy("rule", "expression").agg(F.min(F.struct("n", "token")).alias("rarest"))
        .select("rule", "expression", F.col("rarest.token").alias("token"))
    )
    return ready.drop("tokens").join(rarest, ["rule", "expression"], "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """`pages` (page_id, url) with host, path, rule, verdict and the pattern that decided, if any.

    `rule` is the longest domain rule that fits (ties: the smaller name); without one, an allowing
    pattern outranks a blocking one, and without either the verdict is `default`.
    """
    rules = default_rules(pages.sparkSession) if rules is None else rules
    urls = pages.select("url").distinct()
    index = broadcast_if_small(rule_index(rules, urls), BROADCAST_ROWS)
    url = F.col("url")
    subject = F.when(F.col("is_domain"), F.concat(host_of(url), path_of(url))).otherwise(lower_ascii(F.coalesce(url, F.lit(""))))
    candidates = urls.select("url", F.explode(tokens_of(url)).alias("token")).join(index, "token")
    fits = candidates.filter(F.regexp_like(subject, F.col("expression")))
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("is_domain"), F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("a"), "rule", "action"))).alias("domain"),
        F.max(F.when(~F.col("is_domain"), F.struct((F.col("action") == "allow").alias("a"), "rule", "action"))).alias("pattern"),
    ).withColumnRenamed("url", "judged")
    return pages.select("page_id", "url").join(best, url.eqNullSafe(F.col("judged")), "left").select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), F.col("domain.rule").alias("rule"),
        F.coalesce("domain.action", "pattern.action", F.lit(default)).alias("verdict"),
        F.when(F.col("domain").isNull(), F.col("pattern.rule")).alias("pattern"),
    )
