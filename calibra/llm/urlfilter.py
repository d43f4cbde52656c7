"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A pattern rule is a regular expression and the literal tokens that every match contains as whole tokens, bounded on
both sides in the pattern. Each rule is posted
under the one of its tokens that is rarest in all pages' urls. A url's tokens fetch the rules posted under them, and
only these run their regular expressions on it. Path rules (host and path prefix) are decided first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

#: Path rules as (action, host and path prefix).
PATH_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Pattern rules as (action, pattern on the lower-cased url, literal tokens of every match).
PATTERN_RULES = [
    ("block", r"://([^/?#]*[.])?spam-farm[.]", ["spam", "farm"]),
    ("block", r"://([^/?#]*[.-])?casino[.-]", ["casino"]),
    ("block", r"://([^/?#]*[.-])?porn[.-]", ["porn"]),
    ("block", r"[/._-]viagra([/._-]|$)", ["viagra"]),
    ("block", r"[/._-]payday-loans?([/._-]|$)", ["payday"]),
    ("block", r"[?&]jsessionid=[0-9a-f]+", ["jsessionid"]),
    ("block", r"[?&]replytocom=[0-9]+", ["replytocom"]),
    ("block", r"/cart/(add|checkout)([/?#]|$)", ["cart"]),
    ("block", r"/wp-login[.]php", ["wp", "login"]),
    ("block", r"/link-exchange([/?#]|$)", ["link", "exchange"]),
    ("block", r"[.]zip([?#]|$)", ["zip"]),
    ("block", r"[.]exe([?#]|$)", ["exe"]),
    ("block", r"[.]iso([?#]|$)", ["iso"]),
    ("allow", r"://([^/?#]*[.])?spam-farm[.][^/]*/abuse-report([/?#]|$)", ["spam", "farm", "abuse", "report"]),
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the first ``://``; both empty for null or without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_az(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def path_rule(host: Column, path: Column, rules=PATH_RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest path rule that fits host or a parent domain and the path's start, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_az(url), F.lit("([a-z0-9]+)"), F.lit(1)))


def matched(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """(url, action) of the urls (one column, distinct) that a pattern rule matches; an allow rule outweighs blocks.

    A rule must have a literal token: write alternatives as rules of their own.
    """
    if any(not t for _, _, t in rules):
        raise ValueError("every pattern rule needs a literal token")
    spark = urls.sparkSession
    literal = sorted({t for _, _, ts in rules for t in ts})
    found = urls.where("url is not null").select("url", F.array_intersect(
        tokens(F.col("url")), F.array(*map(F.lit, literal)).cast("array<string>")).alias("found"))
    counts = found.select(F.explode("found").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    posted = spark.createDataFrame([(i, a, p, t) for i, (a, p, t) in enumerate(rules)],
                                   "id int, action string, pattern string, tokens array<string>")
    # one row per rule: a table of fixed size
    index = (posted.select("id", "action", "pattern", F.explode("tokens").alias("token"))
             .join(counts, "token", "left").groupBy("id", "action", "pattern")
             .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rarest"))
             .select("action", "pattern", F.col("rarest.token").alias("token")))
    fetched = (found.select("url", F.explode("found").alias("token"))
               .join(F.broadcast(index), "token"))
    hits = fetched.where(F.expr("regexp_like(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                                "'abcdefghijklmnopqrstuvwxyz'), pattern)"))
    return hits.groupBy("url").agg(F.min("action").alias("action"))  # 'allow' sorts before 'block'


def judge(pages: DataFrame, url_col: str = "url", path_rules=PATH_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """``pages`` plus host, path, rule and verdict. Equal urls are judged once. A null url has empty host and path,
    fits no rule and is allowed. Existing columns of these names are replaced."""
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    hits = matched(urls, pattern_rules).select(F.col("url").alias("__url"), F.col("action").alias("__action"))
    host, path = host_path(F.col(url_col))
    d = pages.drop(*({"host", "path", "rule", "verdict"} - {url_col})).withColumns({"host": host, "path": path})
    rule, action = path_rule(F.col("host"), F.col("path"), path_rules)
    d = d.withColumns({"rule": rule, "__base": action}).withColumn("__url", F.col(url_col))
    d = d.join(hits, "__url", "left")
    return d.withColumn("verdict", F.coalesce("__base", "__action", F.lit("allow"))).drop("__url", "__base", "__action")
