"""URL filters: rules indexed by their rarest literal token.

A rule's index token is the one of its complete literal tokens that the fewest urls hold, counted over all
urls. A url's tokens fetch candidate rules by an equi-join, and only those run their regular expression. All
of it is DataFrame operations; a url's row is expanded to its tokens and folded again by map-side aggregation
before the one shuffle.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Above so many rules the index is joined by a shuffle.
BROADCAST_RULES = 50_000
#: Matches of patterns rank below all host and path rules.
PATTERN_LENGTH = 0


class Rule(NamedTuple):
    """rule: `host/path` prefix, or words in a row (kind `words`) at token borders; verdict: allow or block."""

    rule: str
    verdict: str
    kind: str = "prefix"


# Words, or words in a row, that mark hosts and paths as spam, by kind.
SPAM_WORDS = {
    "gambling": "baccarat, bet365, betting tips, bingo bonus, casino, casinos, free spins, online poker, poker bonus, roulette, slot machine, slot online, slots, sports betting, sportsbook",
    "pharmacy": "buy viagra, buy xanax, canadian pharmacy, cheap meds, cheap pills, cialis, diet pills, online pharmacy, no prescription, phentermine, tramadol, valium, viagra, weight loss pills, xanax",
    "adult": "adult dating, adult video, camgirls, escort service, escorts, hentai, hookup, live cams, nude pics, porn, porno, pornhub, sex chat, sex video, sexcam, webcam girls, xvideos, xxx",
    "pirated": "crack download, cracked apk, download torrent, free keygen, full movie download, keygen, license key generator, mod apk, nulled, patch crack, serial keys, torrent download, warez",
    "money": "binary options, cash advance, debt relief, earn money fast, forex signals, free bitcoin, get rich, loan approval, make money online, no credit check, payday loan, payday loans, work from home jobs",
    "fakes": "cheap jerseys, cheap handbags, fake id, fake passport, louis vuitton outlet, replica bags, replica rolex, replica watches, ray ban outlet, ugg outlet, wholesale jerseys",
    "farms": "article spinner, backlink service, buy backlinks, buy followers, buy likes, buy reviews, link building service, link exchange, link farm, link wheel, paid links, private blog network, seo backlinks, spam farm, traffic bot",
    "bait": "claim your prize, click here now, download now free, free gift card, free iphone, lottery winner, one weird trick, survey reward, win a prize, you have won",
    "parked": "buy this domain, domain for sale, domain parking, parked domain, sedoparking, this domain may be for sale",
    "tracking": "ad server, adclick, adserver, affiliate redirect, clickbank, clicktracker, doubleclick, popunder, redirect ads, track click",
}

#: What decides where no host and path rule fits.
DEFAULT_PATTERNS = tuple(Rule(words.strip(), "block", "words") for kind in SPAM_WORDS.values() for words in kind.split(","))


def pattern_of(rule: Rule) -> str:
    """A regular expression over host + path; over these in lower case for words."""
    if rule.kind == "words":
        return "(^|[^a-z0-9])" + "[^a-z0-9]+".join(map(re.escape, rule.rule.split())) + "([^a-z0-9]|$)"
    host, slash, path = rule.rule.partition("/")
    return r"^([^/]*\.)?" + re.escape(host) + (re.escape(slash + path) if slash else "(/|$)")


def tokens_of(rule: Rule) -> list[str]:
    """Literal tokens that every matching url holds whole. The last of a path prefix may go on in the url."""
    if rule.kind == "words":
        return re.findall("[a-z0-9]+", rule.rule)
    host, _, path = rule.rule.lower().partition("/")
    return sorted({*re.findall("[a-z0-9]+", host), *re.findall("[a-z0-9]+(?=[^a-z0-9])", path)})


def parsed(pages: DataFrame, url_col: str) -> dict:
    """Columns host and path: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to
    `?`, `#` or the end. Null urls and urls without `://` have empty ones."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return {"host": ascii_lower(F.regexp_extract(url, whole, 1)), "path": F.regexp_extract(url, whole, 2)}


def url_verdicts(pages: DataFrame, rules: list[Rule], patterns: list[Rule] | tuple = DEFAULT_PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of every row of pages.

    The longest host and path rule that fits decides, and is named in rule. Else a pattern that matches
    decides, then a url without a host is blocked and any other allowed; rule is null then. Of rules equally
    long the one later in the list wins. Paths of rules are matched as they are, words whatever their case; words
    are in lower case in their rules. Rows that are repeated stay repeated; null ids stay.
    """
    spark = pages.sparkSession
    every = [*rules, *patterns]
    rows = [(i, r.verdict, r.rule if i < len(rules) else None, len(r.rule) if i < len(rules) else PATTERN_LENGTH, r.kind == "words", pattern_of(r), tokens_of(r)) for i, r in enumerate(every)]
    table = spark.createDataFrame(rows, "number int, rule_verdict string, rule string, weight int, words boolean, pattern string, tokens array<string>")
    bounded = F.broadcast if len(every) <= BROADCAST_RULES else (lambda df: df)
    # "" stands for the row itself; rules without a whole token are candidates of every row.
    urls = pages.select(F.col(id_col), *[c.alias(n) for n, c in parsed(pages, url_col).items()])
    tokens = F.array_union(F.array(F.lit("")), F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"))
    expanded = urls.select(id_col, "host", "path", F.explode(tokens).alias("token"))
    literal = table.select("number", F.explode(F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.col("tokens"))).alias("token"))
    seen = expanded.select("token").join(bounded(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("number").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rarest.join(table.select("number", "weight", "words", "pattern"), "number").select(F.col("token").alias("key"), "number", "weight", "words", "pattern")
    whole = F.concat("host", F.when(F.col("words"), ascii_lower(F.col("path"))).otherwise(F.col("path")))
    matched = F.when(F.rlike(whole, F.col("pattern")), F.col("weight").cast("long") * (1 << 31) + F.col("number"))
    best = (
        expanded.join(bounded(index), F.col("token") == F.col("key"), "left")
        # A row is as often in its group as it has entries for "": one for each rule of that key, or one.
        .groupBy(id_col, "host", "path")
        .agg(F.max(matched).alias("best"), F.sum(F.when((F.col("token") == "") & (F.coalesce("number", F.lit(-1)) == F.coalesce(F.lit(first_free(every)), F.lit(-1))), 1).otherwise(0)).alias("copies"))
    )
    named = best.join(bounded(table.select("number", "rule", "rule_verdict")), (F.col("best") % (1 << 31)) == F.col("number"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("host") == "", "block").otherwise("allow"))
    return named.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def first_free(rules: list[Rule]) -> int | None:
    """The first rule without a whole token, if any: it meets each row exactly once."""
    return next((i for i, r in enumerate(rules) if not tokens_of(r)), None)


def url_rules() -> list[Rule]:
    """The rules of the registered query."""
    return [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]
