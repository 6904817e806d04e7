"""URL filters: host rules first, then pattern rules found through their rarest literal token.

A pattern rule is plain text with ``*`` (anything), ``^`` (a separator or the end), a leading ``||`` (start of a host
label), ``|`` at either end (start or end of the URL) and a leading ``@@`` (exception: allows). Each rule is filed
under the rarest of the tokens that any matching URL must hold whole; the tokens of a URL fetch candidate rules, and
only those run their regular expression. Rules without such a token are few and are tried on every URL.

Rules are a parameter with a checked size and travel with the function; URLs are judged row by row in one scan, so
there is no shuffle and no hot key. A null URL has an empty host and path and is allowed.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_RULES = 200_000
# Fixed values: (verdict, rule); the part up to the first slash is a host, the rest the start of a path.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Pattern rules for spam and advertising addresses.
PATTERN_RULES = (
    "||cheap-pills.",
    "||free-casino.",
    "||hot-deals.",
    "||win-prizes.",
    "||adserver.",
    "/banner/*/click^",
    "^affiliate=",
    "^popunder^",
    "@@^affiliate=none^",
)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_TOKEN = re.compile(r"[a-z0-9%]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def pattern_regex(rule: str) -> str:
    """Regular expression over the lower-cased URL of one pattern rule (without ``@@``)."""
    head = tail = ""
    if rule.startswith("||"):
        head, rule = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", rule[2:]
    elif rule.startswith("|"):
        head, rule = "^", rule[1:]
    if rule.endswith("|"):
        tail, rule = "$", rule[:-1]
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c, re.escape(c)) for c in rule.lower()) + tail


def whole_tokens(rule: str) -> list[str]:
    """Tokens that every matching URL holds as whole tokens: no end of them is open."""
    text = rule.lower()
    start_fixed, end_fixed = text.startswith("|"), text.endswith("|")
    text = text.strip("|")
    found = []
    for m in _TOKEN.finditer(text):
        left = text[m.start() - 1] != "*" if m.start() else start_fixed
        right = text[m.end()] != "*" if m.end() < len(text) else end_fixed
        if left and right:
            found.append(m.group())
    return found


class RuleIndex:
    """Host rules by host; pattern rules by their rarest whole token."""

    def __init__(self, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES):
        if len(host_rules) + len(pattern_rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.hosts: dict[str, list[tuple[str, str]]] = {}
        for verdict, rule in host_rules:
            host, slash, path = rule.partition("/")
            self.hosts.setdefault(host.translate(_LOWER), []).append((slash + path, verdict))
        tokens = [whole_tokens(r.removeprefix("@@")) for r in pattern_rules]
        often = Counter(t for ts in tokens for t in set(ts))
        self.by_token: dict[str, list[tuple[bool, str]]] = {}
        self.always: list[tuple[bool, str]] = []
        for rule, ts in zip(pattern_rules, tokens):
            entry = (rule.startswith("@@"), pattern_regex(rule.removeprefix("@@")))
            if ts:
                self.by_token.setdefault(min(ts, key=lambda t: (often[t], -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting host rule as (rule, verdict)."""
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for start, verdict in self.hosts.get(name, ()):
                if name and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                    best = name + start, verdict
        return best

    def candidates(self, url: str) -> list[tuple[bool, str]]:
        found = list(self.always)
        for t in set(_TOKEN.findall(url)):
            found += self.by_token.get(t, ())
        return found

    def by_pattern(self, url: str | None) -> str:
        """block when a pattern rule matches and no exception does, else allow."""
        url = (url or "").translate(_LOWER)
        hit = False
        for allows, regex in self.candidates(url):
            if (allows or not hit) and re.search(regex, url):
                if allows:
                    return "allow"
                hit = True
        return "block" if hit else "allow"

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = self.host_rule(host, path)
        return host, path, rule and rule[0], rule[1] if rule else self.by_pattern(url)


def judge_urls(pages: DataFrame, url_col: str = "url", out: str = "judged", **rules) -> DataFrame:
    """Add the struct ``out`` (host, path, rule, verdict) to every row."""
    index = RuleIndex(**rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.judge(u) for u in urls], columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.withColumn(out, judge(F.col(url_col)))


def report(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url")).select("page_id", "judged.*")


def _sql() -> str:
    fits = []
    for verdict, rule in HOST_RULES:
        host, slash, path = rule.partition("/")
        fits.append(f"({len(rule)}, '{rule}', '{verdict}', '{host}', '{slash + path}')")
    quoted = lambda allow: " OR ".join(f"regexp_matches(lo, '{pattern_regex(r.removeprefix('@@'))}')" for r in PATTERN_RULES if r.startswith("@@") == allow)
    return rf"""
WITH rules(n, rule, verdict, rh, rp) AS (VALUES {", ".join(fits)}),
 p AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS lo,
              coalesce(regexp_extract(url, '^(?s:.*?)://(.*)', 1, 's'), '') AS rest FROM pages),
 h AS (SELECT r, page_id, lo, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 f AS (SELECT h.r, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY h.r)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN ({quoted(True)}) THEN 'allow' WHEN ({quoted(False)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (r)
"""


SQL = _sql()
