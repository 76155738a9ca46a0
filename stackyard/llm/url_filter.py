"""URL filters: allow and block rules by host and path, and pattern rules by token.

Two kinds of rules judge a url.  A place rule is a host and a path prefix; it
fits the host and its subdomains, and the longest one that fits wins.  Where
none fits, the pattern rules decide: regular expressions, any of which blocks.

The literal tokens that a matching url must contain are read off the expression,
for each way to take or leave its optional parts.  A rule is indexed, for each
way, under the rarest of them, as counted over all urls given.  A url's own
tokens fetch the candidate rules from that index, and only those run their
expression, so the cost of a url does not grow with the rule list.

Rules and index are bounded by ``MAX_RULES`` (checked) and travel with the
tasks; urls are judged where they lie, without a shuffle.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
MAX_WAYS = 256   # of one expression (checked)
_TOKEN = re.compile(r"[a-z0-9]+")
#: In a way: where no token goes on, and where anything may stand.
_EDGE, _HOLE = "|", "*"


@dataclass(frozen=True)
class PlaceRule:
    """``host`` and its subdomains, under ``path`` (its beginning)."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url."""
    pattern: str

    @property
    def ways(self) -> tuple[frozenset[str], ...]:
        """Sets of tokens; every url that matches contains all tokens of one of them."""
        return _ways(self.pattern)


#: The rules of hosts and paths.
PLACE_RULES = (
    PlaceRule("net", "/", "block"),
    PlaceRule("example.net", "/en/", "allow"),
    PlaceRule("example.com", "/de/", "block"),
    PlaceRule("org", "/fr/", "allow"),
)

#: Patterns of spam, adult, gambling and tracking urls.
PATTERN_RULES = (
    PatternRule(r"://([^/?#]*\.)?[^/.?#]*\bcheap-pills\b"),
    PatternRule(r"://([^/?#]*\.)?[^/.?#]*\bspam-farm\b"),
    PatternRule(r"://([^/?#]*\.)?(online-)?casino[.-]"),
    PatternRule(r"://([^/?#]*\.)?(free-)?porn[.-]"),
    PatternRule(r"\bviagra\b"),
    PatternRule(r"://([^/?#]*\.)?payday-loans?\b"),
    PatternRule(r"://([^/?#]*\.)?replica-watches\b"),
    PatternRule(r"/wp-login\.php\b"),
    PatternRule(r"[?&]affiliate_id=\d+"),
    PatternRule(r"://([^/?#]*\.)?click-?bait\."),
)


def _symbols(node) -> list[str]:
    """The ways of one node of a parsed expression: literal a-z and 0-9, ``_EDGE`` and ``_HOLE``."""
    kind, value = node
    if kind is op.LITERAL:
        return [chr(value) if _TOKEN.fullmatch(chr(value)) else _EDGE]
    if kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        spans = [(v, v) if k is op.LITERAL else v for k, v in value]
        return [_HOLE if any(a <= ord(z) and ord(y) <= b for a, b in spans for y, z in ("az", "09")) else _EDGE]
    if kind is op.AT and value in (op.AT_BOUNDARY, op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END,
                                   op.AT_END_STRING):
        return [_EDGE]
    if kind is op.SUBPATTERN and not value[1] & re.IGNORECASE:
        return _sequences(value[3])
    if kind is op.BRANCH:
        return [w for branch in value[1] for w in _sequences(branch)]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, part = value
        inner = _sequences(part)
        if most != 1 and any(set(w) != {_EDGE} for w in inner):
            inner = [_HOLE]
        return inner if least else ["", *inner]
    return [_HOLE]


def _sequences(nodes) -> list[str]:
    out = [""]
    for node in nodes:
        out = list(dict.fromkeys(a + b for a, b in product(out, _symbols(node))))
        if len(out) > MAX_WAYS:
            raise ValueError(f"more than {MAX_WAYS} ways through an expression")
    return out


@lru_cache(MAX_RULES)
def _ways(pattern: str) -> tuple[frozenset[str], ...]:
    tree = parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        raise ValueError(f"urls are lower-cased; no (?i) in {pattern}")
    # a token is whole only between edges: what stands next to a hole may go on
    found = {frozenset(re.findall(r"(?<=\|)[a-z0-9]+(?=\|)", way)) for way in _sequences(tree)}
    if not all(found):
        raise ValueError(f"a pattern rule needs a literal token: {pattern}")
    return tuple(sorted(found, key=sorted))


def tokens(url: str) -> set[str]:
    """Runs of letters a-z and digits of the lower-cased url."""
    return set(_TOKEN.findall(url.lower()))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many urls hold each wanted token (at most one row per token reaches the driver)."""
    found = F.expr("array_distinct(filter(split(lower(url), '[^a-z0-9]+'), t -> t != ''))")
    rows = (urls.select(F.explode(found).alias("token")).filter(F.col("token").isin(wanted))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())
    return {r.token: r.n for r in rows}


def build_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[str]]:
    """Token -> patterns of the rules of which it is the rarest token in some way (ties: the first in order)."""
    index = defaultdict(list)
    for r in rules:
        for token in {min(way, key=lambda t: (counts.get(t, 0), t)) for way in r.ways}:
            index[token].append(r.pattern)
    return dict(index)


def _judge(places: tuple[PlaceRule, ...], index: dict[str, list[str]]):
    by_host = defaultdict(list)
    for p in places:
        by_host[p.host].append((len(p.name), p.path, p.name, p.verdict))

    def run(batches):
        import pyarrow as pa
        compiled = {t: [(p, re.compile(p)) for p in ps] for t, ps in index.items()}
        for batch in batches:
            rules, verdicts, patterns = [], [], []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path"))):
                labels = host.split(".")
                fitting = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), ())
                           if path.startswith(r[1])]
                best = max(fitting, default=None)
                hit = None
                if best is None and url:
                    low = url.lower()
                    hit = min((p for t in tokens(low) & compiled.keys()
                               for p, expression in compiled[t] if expression.search(low)), default=None)
                rules.append(best[2] if best else None)
                verdicts.append(best[3] if best else "block" if hit else "allow")
                patterns.append(hit)
            kept = [n for n in batch.schema.names if n != "url"]
            yield pa.record_batch(
                [batch.column(n) for n in kept]
                + [pa.array(c, pa.string()) for c in (rules, verdicts, patterns)],
                names=kept + ["rule", "verdict", "pattern"])
    return run


def _after_scheme(url):
    # what follows the first "://"; null where there is none
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                places: tuple[PlaceRule, ...] = PLACE_RULES,
                patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict, pattern``.

    ``host`` is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; ``path`` goes on up to ``?``, ``#`` or the end.  Both
    are empty for a null url or one without ``://``.  ``rule`` names the longest
    place rule that fits (of equally long ones the last by path and name);
    ``pattern`` is the pattern that blocks, the first in order.  A url that no
    rule meets is allowed.  An empty table gives no rows; ids are carried along.
    """
    if len(places) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    urls = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"))
    index = build_index(patterns, token_counts(urls, sorted({t for r in patterns for way in r.ways for t in way})))
    rest = F.coalesce(F.substring_index(_after_scheme(F.col("url")), "?", 1), F.lit(""))
    host = F.substring_index(F.col("rest"), "/", 1)
    split = urls.withColumn("rest", rest).select(
        "id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.substr(F.col("rest"), F.length(host) + 1).alias("path"), "url")
    judged = split.mapInArrow(
        _judge(places, index),
        "id bigint, host string, path string, rule string, verdict string, pattern string")
    return judged.withColumnRenamed("id", id_col)
