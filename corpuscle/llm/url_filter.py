"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a pattern with a verdict. In a pattern ``*`` stands for any characters, ``^`` for one character that is no ASCII
letter or digit, or for the end; ``||`` at its start means the host or any of its parent domains, ``|`` at its start or
end the URL's own; all else stands for itself. Patterns meet a URL without its scheme, as ``//host/path?query#part``.

Letters and digits between two other characters of a pattern are literal tokens: a URL that fits has them as whole tokens.
The number of URLs that have each token is counted over all rows, and each rule is listed under its rarest one (of several
the longest, then the first by the alphabet; "" if it has none, which every URL has). A URL's tokens fetch the rules
listed under them, and only those run as regular expressions. Of the rules that fit, the one of the highest rank wins, in
a rank the longest, then block before allow, then the last by the alphabet; where none fits, the verdict is ``default``.

Rules up to ``MANY`` are broadcast, of at most ``LONGEST`` characters each (20 MB); longer ones are refused. More are joined
by a shuffle, where tokens of very many URLs are dealt to so many parts that none has over ``PART`` rows.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path
is the rest up to ``?``, ``#`` or the end. A null URL and one without ``://`` have neither, fit no rule and get ``default``.
Each row is judged by itself: null and repeated ids and URLs are rows like any other. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MANY, LONGEST, PART = 20_000, 1000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN, LITERAL = "[a-z0-9]+", r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"
RULES = "rule string, pattern string, verdict string, rank int, any_case boolean"

#: Hosts and paths, with verdicts (fixed values).
SITES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What else goes: words of adult, gambling, drug and spam sites, adverts and trackers, accounts, shops and machinery, and what to keep of those.
WORDS = "adult xxx porn sex escort casino poker bet bets betting slots lottery jackpot pills viagra cialis spam warez torrent keygen payday doubleclick adserver".split()
PATTERNS = (
    *(("block", f"^{w}^") for w in WORDS),
    ("allow", "^adult^education^"), ("allow", "^sex^education^"), ("allow", "^lottery^history^"),
    ("block", "//ads."), ("block", "//ads-"), ("block", ".ads-"), ("block", ".ads."), ("block", "^ad^track^"), ("block", "^ads^track^"), ("block", "/banner^ads^"), ("block", "//tracker."),
    ("block", "^login|"), ("block", "/login^"), ("block", "/signin^"), ("block", "/signup^"), ("block", "/register^"), ("block", "/logout^"),
    ("block", "/wp-admin/"), ("block", "/cgi-bin/"), ("block", "/cart/"), ("block", "/checkout/"), ("block", "/search?"),
    ("block", "?sessionid="), ("block", "&sessionid="), ("block", "?phpsessid="), ("block", "&phpsessid="),
    ("block", "*.exe|"), ("block", "*.apk|"), ("block", "*.zip|"),
)


def site_rules(spark: SparkSession, sites: tuple[tuple[str, str, str], ...], rank: int = 1) -> DataFrame:
    """Rules for (verdict, host, path): the host and its subdomains, where the path starts with ``path``, in its own case."""
    for _, host, path in sites:
        if not path.startswith("/") or set("?#*^|") & set(host + path) or "/" in host or host != host.translate(str.maketrans(UPPER, LOWER)):
            raise ValueError(f"no host and path: {host}{path}")
    return spark.createDataFrame([(host + path, f"||{host}{path}", verdict, rank, False) for verdict, host, path in sites], RULES)


def pattern_rules(spark: SparkSession, patterns: tuple[tuple[str, str], ...], rank: int = 0) -> DataFrame:
    """Rules for (verdict, pattern), whatever the case of ASCII letters."""
    return spark.createDataFrame([(p, p, verdict, rank, True) for verdict, p in patterns], RULES)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and ``//host`` with all that follows it; empty, empty and null without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = lowered(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)\A[^/?#]*(.*)\z", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.concat(F.lit("//"), host, after)


def regex(pattern: Column, any_case: Column) -> Column:
    """The regular expression of a pattern."""
    # stars at the start say nothing, and would take long URLs a time that grows with their square
    body = F.regexp_replace(F.regexp_replace(pattern, r"\A(\|{1,2}|\*+)", ""), r"\|\z", "")
    body = F.regexp_replace(body, r"([\\.+?${}()\[\]|])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", ".*"), r"\^", r"([^a-zA-Z0-9]|\\z)")
    start = F.when(pattern.startswith("||"), r"\A//([^/?#]*\.)?").when(pattern.startswith("|"), r"\A").otherwise("")
    return F.concat(F.when(any_case, "(?si)").otherwise("(?s)"), start, body, F.when(pattern.rlike(r"[^|]\|\z"), r"\z").otherwise(""))


def literals(pattern: Column) -> Column:
    """The tokens that every URL has that fits the pattern."""
    return F.array_distinct(F.regexp_extract_all(lowered(pattern), F.lit(LITERAL), F.lit(0)))


def token_counts(rows: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(token, n): the number of ``rows`` (with ``tokens``) that have each of the ``wanted`` tokens."""
    every = rows.select(F.explode("tokens").alias("token"))
    if few:
        return every.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return every.groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token", "left_semi")


def index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, n, rule, verdict, rank, regex): each rule under its rarest token."""
    one = rules.select("rule", "pattern", "verdict", "rank", "any_case", F.explode_outer(literals(F.col("pattern"))).alias("token"))
    one = one.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = ["rule", "pattern", "verdict", "rank", "any_case"]
    rarest = one.groupBy(*keys).agg(F.min(F.when(F.col("token").isNotNull(), F.struct("n", -F.length("token"), "token"))).alias("least"))
    return rarest.select(F.coalesce("least.token", F.lit("")).alias("token"), F.coalesce("least.n", F.lit(0)).alias("n"), "rule", "verdict", "rank", regex(F.col("pattern"), F.col("any_case")).alias("regex"))


def candidates(rows: DataFrame, listed: DataFrame, few: bool, part: int = PART) -> DataFrame:
    """``rows`` (row, target, tokens) with each rule that is listed under one of their tokens."""
    tokens = rows.where("target is not null").select("row", "target", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
    if few:
        return tokens.join(F.broadcast(listed), "token")
    # "" is in every row
    total = rows.count()
    parts = F.ceil(F.when(F.col("token") == "", F.lit(total)).otherwise(F.col("n")) / part).cast("int")
    listed = listed.withColumn("parts", F.greatest(F.lit(1), parts))
    # tokens of over ``part`` rows are no more than tokens in all rows over ``part``
    hot = listed.where("parts > 1").groupBy("token").agg(F.max("parts").alias("parts"))
    tokens = tokens.join(F.broadcast(hot), "token", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts")
    listed = listed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - F.lit(1).cast("bigint")))).drop("parts")
    return tokens.join(listed.hint("shuffle_hash"), ["token", "share"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", many: int = MANY, part: int = PART) -> DataFrame:
    """(page_id, host, path, rule, rank, verdict) of every row; rule and rank are null where none fits."""
    rules = common.stored(rules.distinct(), "rules")
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.max(F.greatest(F.length("pattern"), F.length("rule"))), F.lit(0)).alias("longest")).head()
    if size["longest"] > LONGEST:
        raise ValueError(f"a rule of over {LONGEST} characters")
    few = size["n"] <= many
    url = F.col("url").cast("string")
    host, path, target = host_and_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), target.alias("target"), F.monotonically_increasing_id().alias("row"))
    rows = common.stored(rows, "urls")  # rows keep their numbers, whatever is lost
    cut = rows.select("row", "target", F.array_distinct(F.regexp_extract_all(lowered(F.col("target")), F.lit(TOKEN), F.lit(0))).alias("tokens"))
    wanted = rules.select(F.explode(literals(F.col("pattern"))).alias("token")).distinct()
    listed = common.stored(index(rules, token_counts(cut, wanted, few)), "rule-index")
    fits = candidates(cut, listed, few, part).where("rlike(target, regex)")
    best = fits.select("row", F.struct("rank", F.length("rule").alias("size"), "verdict", "rule").alias("best"))
    # a number is one row and what fits it: no key has more rows than rules fit one URL
    empty = F.lit(None).cast(best.schema["best"].dataType)
    every = rows.select("row", F.struct("page_id", "host", "path").alias("page"), empty.alias("best")).unionByName(best.select("row", F.lit(None).cast(_page(rows)).alias("page"), "best"))
    found = every.groupBy("row").agg(F.max("page").alias("page"), F.max("best").alias("best"))
    return found.select("page.page_id", "page.host", "page.path", "best.rule", "best.rank", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _page(rows: DataFrame) -> str:
    return f"struct<page_id: {rows.schema['page_id'].dataType.simpleString()}, host: string, path: string>"


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, the site rule, the verdict, and the pattern that gave it where no site rule fits."""
    spark = pages.sparkSession
    found = judge(pages, site_rules(spark, SITES).unionByName(pattern_rules(spark, PATTERNS)))
    site = F.col("rank") == 1
    return found.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern"))


def _sql() -> str:
    """All rules tried on all URLs."""

    def expression(pattern: str) -> str:
        body = pattern.lstrip("|").removesuffix("|").lstrip("*")
        for c in "\\.+?${}()[]":
            body = body.replace(c, "\\" + c)
        body = body.replace("*", ".*").replace("^", "([^a-zA-Z0-9]|\\z)")
        return "(?si)" + body + ("\\z" if pattern.endswith("|") else "")

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sites = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in SITES)
    patterns = ", ".join(f"({quoted(v)}, {quoted(p)}, {quoted(expression(p))})" for v, p in PATTERNS)
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), urls AS (
  SELECT row, page_id, coalesce({lower("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1) AS after, rest IS NOT NULL AS known FROM cut
), sites(verdict, host, path) AS (VALUES {sites}), patterns(verdict, pattern, regex) AS (VALUES {patterns}),
by_site AS (
  SELECT row, arg_max(s.host || s.path, length(s.host || s.path)) AS rule, arg_max(s.verdict, length(s.host || s.path)) AS verdict
  FROM urls u JOIN sites s ON u.known AND (u.host = s.host OR ends_with(u.host, '.' || s.host)) AND starts_with(u.path, s.path) GROUP BY row
), fits AS (
  SELECT row, pattern, verdict, row_number() OVER (PARTITION BY row ORDER BY length(pattern) DESC, verdict DESC, pattern DESC) AS place
  FROM urls JOIN patterns ON known AND regexp_matches('//' || host || after, regex)
)
SELECT u.page_id, u.host, u.path, s.rule, coalesce(s.verdict, f.verdict, 'allow') AS verdict, CASE WHEN s.rule IS NULL THEN f.pattern END AS pattern
FROM urls u LEFT JOIN by_site s USING (row) LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (row)"""


SQL = _sql()
