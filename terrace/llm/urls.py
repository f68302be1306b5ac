"""URL filters: pattern rules under their rarest literal token.

Only rules that a URL's own tokens fetch run their regular expression on it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

#: The listed rules: verdict, host, path (fixed values).
SITES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The method's own rules, in the syntax of ``parse_rules``. Longer lists come from files (``read_rules``).
LINES = (
    "! adult content, gambling, advertisements, tracking, pages without text",
    "^adult^",
    "^casino^",
    "^xxx^",
    "^ads^",
    "^banner*.gif^",
    "^tracker^",
    "^doubleclick^",
    "^login^",
    "^cart^checkout^",
    "@@^casino^museum^",
)
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """One rule. site rules look at host and path, pattern rules at the whole URL."""

    verdict: str
    name: str
    site: bool
    regex: str
    literals: tuple[str, ...]
    weight: int
    match_case: bool = False
    important: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and a path's beginning."""
    bounded = host + path if re.search(r"[^a-z0-9]$", path) else host + path.rpartition("/")[0] + "/"
    return Rule(verdict, host + path, True, rf"^(?:[^/]*\.)?{re.escape(host)}(?-i:{re.escape(path)})", tuple(_TOKEN.findall(bounded.lower())), len(host + path))


def pattern_rule(verdict: str, pattern: str, match_case: bool = False, important: bool = False) -> Rule:
    """A rule with ``^``, ``*`` and anchors. A literal counts where other characters bound it on either side."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    regex = "".join({"^": "(?:^|$|[^a-zA-Z0-9])" if match_case else "(?:^|$|[^a-z0-9])", "*": ".*"}.get(c) or re.escape(c if match_case else c.lower()) for c in body)
    bounded = lambda at, edge: body[at : at + 1] not in ("", "*") if 0 <= at < len(body) else bool(edge)
    literals = [m[0].lower() for m in re.finditer(r"[a-zA-Z0-9]+", body) if bounded(m.start() - 1, head) and bounded(m.end(), tail)]
    return Rule(verdict, pattern, False, head + regex + tail, tuple(literals), len(pattern), match_case, important)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Pattern rules, one a line.

    ``^`` is any one character that is no letter or digit, or an end; ``*``
    any text; ``||`` the beginning of a host or of one of its subdomains;
    ``|`` the beginning or end of the URL. ``@@`` before a rule makes it an
    exception, which allows what other rules block. ``$match-case`` after it
    keeps capitals apart, ``$important`` lets it block in spite of exceptions.
    Lines that are empty or begin with ``!`` are comments; other options raise.
    """
    out = []
    for line in map(str.strip, lines):
        if not line or line.startswith("!"):
            continue
        body, _, options = line.partition("$")
        chosen = set(filter(None, options.split(",")))
        if unknown := chosen - {"match-case", "important"}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        verdict = "allow" if body.startswith("@@") else "block"
        out.append(pattern_rule(verdict, body.removeprefix("@@"), "match-case" in chosen, "important" in chosen))
    return out


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a text file or folder. All workers hold them, so they must fit into memory, as any rule list does."""
    return parse_rules(r[0] for r in spark.read.text(path).collect())


def default_rules() -> list[Rule]:
    return [site_rule(*s) for s in SITES] + parse_rules(LINES)


def split(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.search(r"[/?#]", rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), re.split(r"[?#]", rest, maxsplit=1)[0]


def _tokens(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").lower()))


class Index:
    """Rules by key token; those without a literal are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.always: list = []
        self.by_token: dict[str, list] = defaultdict(list)
        for r in rules:
            entry = (r, re.compile(r.regex, re.I | re.A if r.site else re.A))
            key = min(r.literals, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.always if key is None else self.by_token[key]).append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        host, path = split(url)
        low, site = (url or "").lower(), host + path
        best, blocked, allowed, forced, tried = None, None, False, False, 0
        entries = [*self.always, *(e for t in _tokens(url) for e in self.by_token.get(t, ()))]
        for rule, regex in entries:
            tried += 1
            if rule.site:
                if (best is None or rule.weight > best.weight) and regex.search(site):
                    best = rule
            elif regex.search((url or "") if rule.match_case else low):
                allowed |= rule.verdict == "allow"
                if rule.verdict == "block":
                    forced |= rule.important
                    if blocked is None or rule.name < blocked:
                        blocked = rule.name
        verdict = best.verdict if best else "block" if blocked and (forced or not allowed) else "allow"
        return host, path, best.name if best else None, verdict, blocked, tried


def judge_urls(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of each URL: page_id, host, path, rule, verdict, pattern, rules_tried.

    The longest listed host and path rule that fits decides; without one, a
    fitting ``block`` pattern blocks unless an exception fits too (and even
    then if it is important), and all else is allowed. Which literal of a rule is rarest comes from counts
    over all URLs, of the rules' own literals only: a result that the rules
    bound. Null and empty URLs, and those without ``://``, have empty host and
    path. Rows are judged one by one, so repeated rows and null ids stay; only
    the two named columns are read; no shuffle but those counts.
    """
    scratch.prepare(df.sparkSession)
    rules = default_rules() if rules is None else rules
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    wanted = sorted({t for r in rules for t in r.literals})
    words = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), F.lit(1)))
    seen = pages.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, wanted)))).alias("t")).groupBy("t").count() if wanted else None
    counts = {r["t"]: r["count"] for r in seen.collect()} if seen is not None else {}
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("rules_tried", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for b in batches:
            if b.num_rows:
                yield arrow.batch(schema, b.column(0), *map(list, zip(*map(index.judge, b.column(1).to_pylist()))))

    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string, rules_tried long")


def oracle_sql() -> str:
    """DuckDB SQL for the first five columns' meaning, with the rules spelt out."""
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    longest = sorted(SITES, key=lambda s: -len(s[1] + s[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    match = lambda r: f"regexp_matches(lower(coalesce(url, '')), '{r.regex}')"
    patterns = parse_rules(LINES)
    allow = " OR ".join(match(r) for r in patterns if r.verdict == "allow")
    block = " OR ".join(match(r) for r in patterns if r.verdict == "block")
    name = "CASE " + " ".join(f"WHEN {match(r)} THEN '{r.name}'" for r in sorted(patterns, key=lambda r: r.name) if r.verdict == "block") + " END"
    return f"""
        WITH parts AS (
          SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
          SELECT page_id, url, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts)
        SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN ({block}) AND NOT ({allow}) THEN 'block' ELSE 'allow' END AS verdict, {name} AS pattern FROM split"""
