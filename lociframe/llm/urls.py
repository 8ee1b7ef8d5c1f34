"""URL rules indexed by their rarest literal token.

A rule's pattern is literal text with ``*`` for anything; it may be tied to a
host. Its tokens are the runs of letters and digits that stand, in any URL that
it fits, between other characters; each rule is filed under the one that the
fewest rules have. A URL's own tokens fetch candidates, and only their regular
expressions run. Rules without such a token are candidates for every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the query: host and path rules, the longest that fits decides.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The method's own rules for URLs that none of those fits; block if any fits.
PATTERN_RULES = ("spam-farm.", "ads-track.", "/adserver/", "*/click?*redirect=*", "casino-*.html", "doubleclick.")
#: Rules up to which the index is sent to every task.
MOST_RULES = 1_000_000
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    host: bool = False

    def regex(self) -> str:
        """For ``host/path`` of a URL; a host rule begins at a label of the host."""
        if self.host:
            host, slash, path = self.text.partition("/")
            return r"\A(?:[^/]*\.)?" + re.escape(host) + ("/" + re.escape(path) if slash else "(?:/|\\Z)")
        return ".*".join(map(re.escape, self.text.split("*")))

    def tokens(self) -> list[str]:
        out = []
        for part in [self.text] if self.host else self.text.split("*"):
            for m in TOKEN.finditer(low := part.lower()):
                closed = m.end() < len(low) or self.host and "/" not in low
                if closed and (m.start() or self.host):
                    out.append(m[0])
        return out


class Index:
    """Candidates by token."""

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        if len(rules) > MOST_RULES:
            raise ValueError("too many rules to send to every task")
        seen = Counter(t for r in rules for t in set(r.tokens()))
        self.by_token, self.always = defaultdict(list), []
        for r in rules:
            rarest = min(r.tokens(), key=lambda t: (seen[t], -len(t), t), default=None)
            (self.always if rarest is None else self.by_token[rarest]).append((r, re.compile(r.regex(), re.S)))

    def matches(self, where: str, tokens: set[str]) -> list[Rule]:
        lists = [self.always, *(self.by_token[t] for t in tokens if t in self.by_token)]
        return [r for rules in lists for r, regex in rules if regex.search(where)]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest) if sep else None
    if not m:
        return "", ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one for each row of ``pages`` (``page_id``, ``url``).

    A null url, and one without ``://``, has an empty host and path, fits no
    host rule and is allowed. Rows are judged one by one, so ids may be null or
    repeat; an empty table gives no rows. Of two host rules of the same length the first in
    code-point order decides.
    """
    host_rules = [Rule(text, verdict, host=True) for verdict, text in host_rules]
    pattern_rules = [Rule(text, "block") for text in pattern_rules]

    def batch(batches):
        import pyarrow as pa

        index = Index([*host_rules, *pattern_rules])
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                rest = (url or "").partition("://")[2]
                fit = index.matches(host + (path or "/") + rest[len(host) + len(path) :], set(TOKEN.findall(rest.lower()))) if host or path else []
                rule = min((r for r in fit if r.host and _starts(r, host, path)), key=lambda r: (-len(r.text), r.text), default=None)
                verdict = rule.verdict if rule else "block" if any(not r.host for r in fit) else "allow"
                rows.append((host, path, rule and rule.text, verdict))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (zip(*rows) if rows else [[]] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(batch, "page_id long, host string, path string, rule string, verdict string")


def _starts(rule: Rule, host: str, path: str) -> bool:
    """Host rules speak of the path alone, an empty one included, not of what follows it."""
    want = rule.text.partition("/")
    return path.startswith(want[1] + want[2])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


OP3_SQL = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
host AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, rest, length(h) AS n FROM cut),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fit AS (
  SELECT host.*, rules.rule, rules.verdict,
         row_number() OVER (PARTITION BY page_id, host, path, rest ORDER BY length(rules.rule) DESC) AS k
  FROM host LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
whole AS (
  SELECT *, CASE WHEN host = '' AND path = '' THEN ''
            ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || substr(rest, n + length(path) + 1) END AS u
  FROM fit WHERE k = 1)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN verdict
       WHEN regexp_matches(u, 'spam-farm\.|ads-track\.|/adserver/|doubleclick\.', 's')
         OR regexp_matches(u, '/click\?.*redirect=|casino-.*\.html', 's') THEN 'block'
       ELSE 'allow' END AS verdict
FROM whole
"""
