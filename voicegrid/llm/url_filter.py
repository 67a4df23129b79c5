"""URL verdicts by pattern rules that are indexed by their rarest literal token.

Two kinds of rules:

* prefix rules ``host/path``: they fit their host and all its subdomains, if the
  URL's path begins with the rule's; the longest that fits decides.
* pattern rules, regular expressions over what follows ``://``, host in lower case,
  with the literal tokens that any match must hold; they decide where no prefix rule
  fits, the first in the list that fits first. ``word_rule`` makes one of a host
  label, ``wildcard_rule`` one of a filter line: ``*`` is anything, ``^`` a separator or the
  end, ``||`` at its beginning the begin of a host label, ``|`` at its end the end.

Rules come as a list or as a table (``rules_of``). A token is a run of letters and
digits. How often each literal of a rule occurs is counted over all URLs, and the
rule is filed under its rarest literal. The tokens of a URL fetch the rules filed under
them, and only those run their regular expressions. The rules are a bounded list
(``MAX_RULES``, beyond which judging fails), broadcast with their index; URLs are judged
where they are read, so nothing but the counts of the rules' own literals is shuffled.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case. Path: from there up to ``?``, ``#`` or the end. Null URLs and such without
``://`` have both empty; no prefix rule fits them, and pattern rules see an
empty text. Rows that repeat and ties are judged alike; null ids stay; very long URLs
are judged whole; an empty table stays empty. Other columns of the table, whatever
their names, don't matter. URLs that no rule fits get ``default``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
_TOKEN = re.compile("[A-Za-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    length: int = 0  # of a prefix rule; 0: a pattern rule


def prefix_rule(text: str, verdict: str) -> Rule:
    """``host/path``. The last token of the path may go on in the URL, so it is no literal."""
    host, slash, path = text.partition("/")
    literals = _TOKEN.findall(host)
    inner = path[: len(path) - len(re.search("[A-Za-z0-9]*$", path)[0])]
    return Rule(text, verdict, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(literals + _TOKEN.findall(inner)), len(text))


def word_rule(words: str, verdict: str) -> Rule:
    """A host label, or part of one between hyphens, that is these words."""
    return Rule(words, verdict, rf"\A(?:[^/?#]*[.-])?{re.escape(words)}(?:[.-]|\Z|(?=[/?#]))", tuple(_TOKEN.findall(words)))


def wildcard_rule(line: str, verdict: str) -> Rule:
    """A filter line. A token counts as literal if the line itself bounds it on both sides."""
    body, host, end = line.removeprefix("||").removesuffix("|"), line.startswith("||"), line.endswith("|")
    signs = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
    pattern = (r"\A(?:[^/?#]*\.)?" if host else "") + "".join(signs.get(c) or re.escape(c) for c in body) + (r"\Z" if end else "")
    bounded = f"{'^' if host else '*'}{body}{'^' if end else '*'}"
    literals = [m[0] for m in _TOKEN.finditer(bounded) if "*" not in (bounded[m.start() - 1], bounded[m.end()])]
    return Rule(line, verdict, pattern, tuple(literals))


_MAKERS: dict[str, Callable[[str, str], Rule]] = {"prefix": prefix_rule, "word": word_rule, "wildcard": wildcard_rule}


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (position, kind, rule, verdict), kinds ``prefix``, ``word`` and ``wildcard``; no more than ``MAX_RULES`` are fetched."""
    rows = table.select("position", "kind", "rule", "verdict").orderBy("position").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(_MAKERS[r["kind"]](r["rule"], r["verdict"]) for r in rows)


#: The rules for hosts and paths.
PREFIX_RULES = (
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
)
#: Words in host names of sites with no text worth training on.
BLOCKED_WORDS = ("casino", "poker", "betting", "jackpot", "porn", "xxx", "adult", "escort", "viagra", "pills", "payday", "torrent", "warez", "adserver", "doubleclick")
WORD_RULES = tuple(word_rule(w, "block") for w in BLOCKED_WORDS)


class RuleIndex:
    """Rules by literal token; rules without a literal are tried on every URL."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int], default: str):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; {MAX_RULES} are broadcast at most")
        self.default = default
        # Prefix rules first, the longest first: the first that fits decides.
        self.rules = sorted(rules, key=lambda r: -r.length)
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, rule in enumerate(self.rules):
            if rule.literals:
                self.filed.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}

    def fits(self, place: str) -> Rule | None:
        found = set(self.always)
        for token in set(_TOKEN.findall(place)):
            found.update(self.filed.get(token, ()))
        for k in sorted(found):
            pattern = self.compiled.get(k)
            if pattern is None:
                pattern = self.compiled[k] = re.compile(self.rules[k].pattern, re.DOTALL)
            if pattern.search(place):
                return self.rules[k]
        return None


def split_url(url: str = "url"):
    """(host, path, rest) columns."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)(.*)"
    host, path, rest = (F.coalesce(F.regexp_extract(F.col(url), parts, k), F.lit("")) for k in (1, 2, 3))
    return F.translate(host, _UPPER, _LOWER), path, rest


def literal_counts(places: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs of ``places`` (place) that hold each literal of the rules."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    known = places.sparkSession.createDataFrame([(t,) for t in literals], "token string")  # one row a literal of a bounded list
    tokens = places.select(F.explode(F.array_distinct(F.regexp_extract_all("place", F.lit("([A-Za-z0-9]+)"), 1))).alias("token")).join(F.broadcast(known), "token")
    return {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + WORD_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of a prefix rule), verdict, pattern (of a pattern rule) of every row of ``pages`` (page_id, url)."""
    host, path, rest = split_url()
    split = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    index = RuleIndex(rules, literal_counts(split.select(F.concat("host", "path", "rest").alias("place")), rules), default)
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, rests = (batch.column(c).to_pylist() for c in ("host", "path", "rest"))
            found = [shared.value.fits(h + p + r) for h, p, r in zip(hosts, paths, rests, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "host", "path")),
                    pa.array([r.name if r and r.length else None for r in found], pa.string()),
                    pa.array([r.verdict if r else shared.value.default for r in found], pa.string()),
                    pa.array([r.name if r and not r.length else None for r in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return split.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string, pattern string")


ORACLE_SQL = rf"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split),
worded AS (
  SELECT *, CASE WHEN rule IS NULL THEN list_filter([{', '.join(f"'{w}'" for w in BLOCKED_WORDS)}], lambda w: regexp_matches(host, '(^|[.-])' || w || '($|[.-])'))[1] END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM worded
"""
