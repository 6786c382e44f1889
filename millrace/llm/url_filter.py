"""URL filters: domain rules, then pattern rules found by their rarest literal token.

A pattern rule is a regular expression with the literal tokens (runs of a-z and 0-9 in the lower-cased URL) that every
URL it matches must have, or with alternatives of which every such URL has one; that they are bound to occur is checked
against the parsed expression (literal_tokens). The rule is indexed under the one of its tokens that the fewest URLs have,
counted over all URLs, or under all of its alternatives. A URL's own tokens fetch candidate rules from that index, and only
those run their regular expressions. Domain rules are fetched by the host and its parent domains.

Both indexes are hash tables that each worker gets once; URLs pass by them without a shuffle. More than RULES_A_PASS rules
are cut into parts, and the URLs pass by one part after the other: a worker holds the rules of one part at a time.

Expressions are written in what Java's, Python's and RE2's syntax have in common.

Defined results: a null URL or one without "://" has an empty host and path, no rule, and verdict "allow"; empty tables
give empty results; repeated rows are judged alike, each by itself; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a worker holds at a time, at about 300 bytes each, compiled expressions aside.
RULES_A_PASS = 100_000


@dataclass(frozen=True)
class DomainRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """tokens: every matching URL has all of them; either: every matching URL has one of them at least. One of the two is given."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    either: tuple[str, ...] = ()


#: Production rules. Every pattern is matched against the lower-cased URL.
DOMAIN_RULES = (
    DomainRule("allow", "org", "/"),
    DomainRule("block", "example.org", "/es/"),
    DomainRule("block", "example.org", "/en/1"),
    DomainRule("allow", "com", "/fr/"),
    DomainRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    PatternRule("block", r"[/.]casino-win[./]", ("casino", "win")),
    PatternRule("block", r"[/.]free-bets?[./]", ("free",)),
    PatternRule("block", r"[/.]cheap-pills?[./]", ("cheap",)),
    PatternRule("block", r"[/.](?:xxx|adult)-[a-z0-9-]*videos?[./]", either=("xxx", "adult")),
    PatternRule("block", r"[?&]utm_source=spam(?:&|#|$)", ("utm", "source", "spam")),
    PatternRule("block", r"/wp-login\.php(?:[?#]|$)", ("wp", "login", "php")),
    PatternRule("block", r"[?&]replytocom=[0-9]+", ("replytocom",)),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: str) -> tuple[str, set[str]]:
    """The URL with A-Z lower-cased, and its tokens."""
    lowered = url.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return lowered, set(_TOKENS(lowered))


_TOKENS = re.compile("[a-z0-9]+").findall
_EDGE, _ANY = object(), object()


def literal_tokens(pattern: str) -> tuple[set[str], list[set[str]]]:
    """(tokens that every match must have, sets of tokens of which every match must have one).

    A run of token characters counts if what stands on both of its sides can't be one: another literal, a set of such, or an
    anchor. Anything else (repeats, classes, ends of the expression) leaves open how a token goes on, so its runs don't count.
    """
    sure: set[str] = set()
    either: list[set[str]] = []
    run: list[list[str]] | None = None  # what follows an edge so far: literals, or one group of alternatives
    for item in [*_items(_parser.parse(pattern)), _ANY]:
        if item is _EDGE:
            if run and all(len(x) == 1 for x in run):
                sure.add("".join(x[0] for x in run))
            elif run and len(run) == 1:
                either.append(set(run[0]))
            run = []
        elif item is _ANY:
            run = None
        elif run is not None:
            run.append(item)
    return sure, either


def _items(parsed) -> Iterator:
    """_EDGE, _ANY, or the alternatives of a stretch of token characters."""
    for op, value in parsed:
        if op is K.LITERAL:
            yield [chr(value)] if _TOKENS(chr(value)) else _EDGE
        elif op is K.AT:
            yield _EDGE
        elif op is K.IN:
            yield _EDGE if all(o is K.LITERAL and not _TOKENS(chr(v)) for o, v in value) else _ANY
        elif op is K.SUBPATTERN:
            yield from _items(value[-1])
        elif op is K.BRANCH:
            ways = [list(_items(w)) for w in value[1]]
            if all(w and all(x is _EDGE for x in w) for w in ways):
                yield _EDGE
            elif all(w and all(isinstance(x, list) and len(x) == 1 for x in w) for w in ways):
                yield ["".join(x[0] for x in w) for w in ways]
            else:
                yield _ANY
        else:
            yield _ANY


def at_end(pattern: str) -> str:
    """The pattern as Python takes it: a `$` that ends an alternative is the end of the text, not also the place before a last line end."""
    return re.sub(r"(?<!\\)\$(?=[|)]|$)", r"\\Z", pattern)


def check_rules(rules: tuple[PatternRule, ...]) -> None:
    for r in rules:
        sure, either = literal_tokens(r.pattern)
        if not r.tokens and not r.either or not set(r.tokens) <= sure or r.either and not any(own <= set(r.either) for own in either):
            raise ValueError(f"{r.pattern}: tokens {r.tokens or r.either} aren't bound to occur in a match; sure are {sorted(sure)} and {either}")


def rarest_tokens(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, list[int]]:
    """Index: token -> numbers of the rules kept under it. Frequencies are counted over all URLs; one count per rule token comes to the driver."""
    wanted = urls.sparkSession.sparkContext.broadcast({t for r in rules for t in r.tokens})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column("url").to_pylist():
                seen.update(tokens_of(url or "")[1] & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counts = {}
    if wanted.value:
        found = urls.select("url").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
        counts = {r["token"]: r["n"] for r in found.collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for token in [min(r.tokens, key=lambda t: (counts.get(t, 0), t))] if r.tokens else sorted(set(r.either)):
            index.setdefault(token, []).append(i)
    return index


def domain_index(rules: tuple[DomainRule, ...]) -> dict[str, list[tuple[int, str, str, str]]]:
    """Host -> (minus length, rule, path, verdict) of its rules, best first."""
    index: dict[str, list[tuple[int, str, str, str]]] = {}
    for r in rules:
        index.setdefault(r.host, []).append((-len(r.host + r.path), r.host + r.path, r.path, r.verdict))
    return {host: sorted(own) for host, own in index.items()}


def domain_rule(host: str, path: str, index: dict[str, list[tuple[int, str, str, str]]]) -> tuple[int, str, str, str] | None:
    """The longest rule whose host is the URL's or a parent domain and whose path starts the URL's."""
    best, at = None, 0
    while True:
        for rule in index.get(host[at:], ()):
            if path.startswith(rule[2]):
                best = rule if best is None else min(best, rule)
                break
        at = host.find(".", at) + 1
        if not at:
            return best


def one_pass(judged: DataFrame, domains: tuple[DomainRule, ...], patterns: tuple[PatternRule, ...]) -> DataFrame:
    """judged with what these rules say: a longer domain rule replaces the one found before, a pattern rule only fills what is open."""
    check_rules(patterns)
    index = rarest_tokens(judged, patterns)
    shared = judged.sparkSession.sparkContext.broadcast((domain_index(domains), index, [(r.pattern, r.verdict) for r in patterns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, fetched, rules = shared.value
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("url", "host", "path", "rule", "base", "found")}
            for row, (url, host, path) in enumerate(zip(columns["url"], columns["host"], columns["path"], strict=True)):
                fits = domain_rule(host, path, hosts)
                old = columns["rule"][row]
                if fits and (old is None or fits[:2] < (-len(old), old)):
                    columns["rule"][row], columns["base"][row] = fits[1], fits[3]
                if columns["found"][row] is None and url:
                    lowered, tokens = tokens_of(url)
                    for k in sorted({k for t in tokens if t in fetched for k in fetched[t]}):
                        if k not in compiled:
                            compiled[k] = re.compile(at_end(rules[k][0]))
                        if compiled[k].search(lowered):
                            columns["found"][row] = rules[k][1]
                            break
            out = [batch.column("id"), *[batch.column(c) for c in ("url", "host", "path")], *[pa.array(columns[c], pa.string()) for c in ("rule", "base", "found")]]
            yield pa.RecordBatch.from_arrays(out, ["id", "url", "host", "path", "rule", "base", "found"])

    return judged.mapInArrow(run, judged.schema)


def judge_urls(urls: DataFrame, domain_rules: tuple[DomainRule, ...] = DOMAIN_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict: the longest domain rule's verdict, else the first matching pattern rule's, else "allow"."""
    url, none = F.col(url_col), F.lit(None).cast("string")
    judged = urls.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), none.alias("rule"), none.alias("base"), none.alias("found"))
    for at in range(0, max(len(domain_rules), len(pattern_rules)), RULES_A_PASS):
        judged = one_pass(judged, domain_rules[at : at + RULES_A_PASS], pattern_rules[at : at + RULES_A_PASS])
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("base", "found", F.lit("allow")).alias("verdict"))
