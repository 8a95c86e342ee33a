"""URL filters: pattern rules indexed by their rarest literal token, in Spark expressions only.

A rule is a regular expression over ``host + path`` with the literal tokens (runs of a-z and 0-9) that any match must
hold, at least one. Each rule is filed under the one of its tokens that is rarest in the urls at hand; a url's tokens
fetch the rules filed under them, and only those run their expressions. Literal host-and-path rules are such rules too,
and win over the plain patterns.

:func:`judge` files rules that the program states, in a map literal: no shuffle. :func:`judge_by_table` takes rules of any
number from a table and joins them to the tokens of the distinct addresses.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; repeated rows stay;
of the literal rules that fit the longest text wins, of the patterns the first listed; a rule without a token is refused;
columns that have the names of results give way to them; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, stored

#: Rules that one map literal of the plan holds; more take more literals.
LITERAL_RULES = 200
#: Filed rules that are broadcast to the tokens; more are joined by a shuffle.
BROADCAST_RULES = 200_000
RESULTS = ("host", "path", "rule", "verdict", "pattern")


@dataclass(frozen=True)
class Rule:
    """name: shown in the result; verdict: allow or block; regex: Java and RE2 syntax over host + path; tokens: literals that every match holds as whole tokens; literal: wins over patterns."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    literal: bool = False

    def __post_init__(self):
        if not self.tokens:
            raise ValueError(f"rule {self.name} has no token to be filed under")


def path_rule(verdict: str, text: str) -> Rule:
    """`example.net/en/`: the host and its subdomains, paths that start with /en/. The last path token is not sure to be a whole token of the url unless a separator follows it."""
    host, _, path = text.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + [t for t in re.findall(r"([a-z0-9]+)(?=[^a-z0-9A-Z])", f"/{path}") if t.islower() or t.isdigit()]
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole), True)


def host_rule(word: str) -> Rule:
    """Hosts that hold the word between dots or hyphens."""
    return Rule(f"{word} host", "block", rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,))


def page_rule(word: str) -> Rule:
    """Paths with a step that is the word, with an ending or not."""
    return Rule(f"{word} page", "block", rf"/{word}(?:[/.]|$)", (word,))


def word_rule(word: str) -> Rule:
    """The word anywhere, as a whole token."""
    return Rule(word, "block", rf"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,))


#: Fixed values of the contract.
RULES = (
    path_rule("block", "net/"),
    path_rule("allow", "example.net/en/"),
    path_rule("block", "example.com/de/"),
    path_rule("allow", "org/fr/"),
)

#: Words of unwanted sites: in hosts, as steps of paths, anywhere. The first that fits decides.
HOSTS = ("adult", "spam", "farm", "porn", "xxx", "escort", "pharmacy", "pills", "payday", "loans", "torrent", "warez", "doubleclick", "adserver", "tracker")
PAGES = ("login", "signin", "logout", "signup", "register", "cart", "checkout", "captcha")
ANYWHERE = ("casino", "viagra", "cialis", "jackpot", "blackjack", "roulette", "sportsbook", "replica")
PATTERNS = (*map(host_rule, HOSTS), *map(word_rule, ANYWHERE), *map(page_rule, PAGES))


def rest_of(url: str) -> Column:
    """What follows the first :// of a column, else nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def host_of(url: str) -> Column:
    """Of a column: after the first :// up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """Of a column: what follows the host up to ? # or the end."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(target: str) -> Column:
    """The tokens of a target, each once."""
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def rarest(urls: DataFrame, target: str, rules: tuple[Rule, ...]) -> dict[str, str]:
    """rule name -> its literal token that fewest urls hold. At most one count a rule token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {r["t"]: r["count"] for r in urls.select(F.explode(tokens_of(target)).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count().collect()} if wanted else {}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules}


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (of the literal rule, else null), ``verdict`` and ``pattern`` (of the pattern that decided, else null).

    Rules are filed in map literals of LITERAL_RULES each, so that a url is judged within its own row: no shuffle, no
    skew by a common token. Each literal is one pass of expressions.
    """
    every = tuple(rules) + tuple(patterns)
    if len({r.name for r in every}) < len(every):
        raise ValueError("rule names must differ")
    df, keep, target, tokens, hits = addressed_with(pages, url_col)
    filed = rarest(df.select(target), target, every)
    df = df.withColumn(tokens, tokens_of(target))
    found = [fits(every[i : i + LITERAL_RULES], filed, i, target, tokens) for i in range(0, len(every), LITERAL_RULES)]
    df = df.withColumn(hits, F.concat(*found) if found else F.array().cast("array<int>"))
    # the best of either kind; both lists are short
    at = {r.name: i for i, r in enumerate(every)}
    rank = [sorted((r.name for r in rules), key=lambda n: (-len(n), at[n])), [r.name for r in patterns]]
    first = [F.coalesce(*[F.when(F.array_contains(hits, at[n]), F.lit(n)) for n in names], F.lit(None).cast("string")) for names in rank]
    verdict = lambda col, group: F.coalesce(*[F.when(F.col(col) == r.name, F.lit(r.verdict)) for r in group], F.lit(None).cast("string"))
    df = df.withColumn("rule", first[0]).withColumn("pattern", F.when(F.col("rule").isNull(), first[1]))
    return df.withColumn("verdict", F.coalesce(verdict("rule", rules), verdict("pattern", patterns), F.lit(default))).select(*[F.col(f"`{c}`") for c in keep], *RESULTS)


def addressed_with(pages: DataFrame, url_col: str) -> tuple[DataFrame, list[str], str, str, str]:
    """pages with host, path and the target that rules see; the names of the columns that stay, and three of its own."""
    keep = [c for c in pages.columns if c.lower() not in RESULTS]
    url, target, tokens, hits = own_names(pages.columns, 4)
    df = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias(url))
    df = df.select(*[F.col(f"`{c}`") for c in keep], host_of(url).alias("host"), path_of(url).alias("path"))
    return df.withColumn(target, F.concat("host", "path")), keep, target, tokens, hits


def fits(rules: tuple[Rule, ...], filed: dict, base: int, target: str, tokens: str) -> Column:
    """Numbers of the rules that fit: the url's tokens fetch candidates, whose expressions then run."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(filed[r.name], []).append(i + base)
    table = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    fetched = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<int>"))))
    regex = F.array(*[F.lit(r.regex) for r in rules])
    return F.filter(fetched, lambda i: F.regexp(F.col(target), F.element_at(regex, i - base + 1)))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as a table: n (their order), name, verdict, regex, tokens, literal."""
    rows = [F.struct(F.lit(i).cast("long").alias("n"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.array(*map(F.lit, r.tokens)).alias("tokens"), F.lit(r.literal).alias("literal")) for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge_by_table(pages: DataFrame, table: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same by rules of any number in a table (see :func:`rule_table`): rules meet the tokens of the distinct addresses in a join, so a common address or token costs a row for each of its distinct addresses at most. Rules without a token are left out."""
    df, keep, target, *_ = addressed_with(pages, url_col)
    urls = df.select(F.col(target).alias("target")).distinct()
    held = urls.select("target", F.explode(tokens_of("target")).alias("token"))
    own = table.select("n", F.explode(F.array_distinct("tokens")).alias("token"))
    counts = held.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("k"))
    filed = own.join(counts, "token", "left").groupBy("n").agg(F.min_by("token", F.struct(F.coalesce("k", F.lit(0)), "token")).alias("token"))
    filed = stored(filed.join(table.drop("tokens"), "n"), "filed")
    if filed.count() <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    hits = held.join(filed, "token").where(F.regexp("target", F.col("regex")))
    best = lambda what, of: F.min_by(F.struct("name", "verdict"), F.when(what, of))
    rank = F.struct(F.when(F.col("literal"), -F.length("name")).otherwise(0).alias("size"), "n")
    per = hits.groupBy("target").agg(best(F.col("literal"), rank).alias("r"), best(~F.col("literal"), rank).alias("p"), F.max("literal").alias("literal"))
    out = df.join(per.withColumnRenamed("target", target), target, "left")
    rule = F.when(F.col("literal"), F.col("r"))
    pattern = F.when(~F.coalesce("literal", F.lit(False)), F.col("p"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule["name"].alias("rule"), F.coalesce(rule["verdict"], pattern["verdict"], F.lit(default)).alias("verdict"), pattern["name"].alias("pattern"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


_U = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_CASES = "\n        ".join(f"WHEN regexp_matches(host || path, '{r.regex}') THEN '{r.name}'" for r in PATTERNS)
ORACLE = rf"""
WITH u AS (SELECT page_id, {_U} AS rest FROM pages),
h AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
p AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
        {_CASES} END AS pattern FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM p
"""
