"""URL filter: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import map_arrow, strings

TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: What marks an address as one to leave out where no rule of the caller's fits: words anywhere, labels of hosts, last labels,
#: directories, endings of files, and parts of queries that were put into paths.
SPAM_WORDS = ("casino", "pills", "viagra", "cialis", "poker", "jackpot", "porn", "xxx", "escort", "spam", "warez", "payday", "replica")
AD_LABELS = ("ads", "adserver", "adservice", "banners", "click", "popunder", "tracker", "tracking", "telemetry")
DARK_ENDS = ("onion", "i2p", "exit", "invalid")
PRIVATE_DIRECTORIES = ("cgi-bin", "wp-admin", "wp-login", "phpmyadmin", "admin", "checkout", "cart", "logout")
BINARY_ENDINGS = ("exe", "msi", "apk", "dmg", "iso", "torrent", "bin", "dll", "jar")


@dataclass(frozen=True)
class UrlRule:
    """A rule's regular expression is searched in host + path (\\z stands for the end, as in SQL engines); `tokens` are literals
    that every match contains whole, in either case: without other letters or digits of A-Z, a-z and 0-9 beside them."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple[int, int] = (0, 0)


def any_case(literal: str) -> str:
    """A pattern for a literal in which letters of A-Z stand for both cases, and no other letters for them."""
    return "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else re.escape(c) for c in literal.translate(_UPPER))


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host and all its subdomains, and paths that begin with `path`. Longer rules win over shorter ones."""
    host = host.translate(_UPPER)
    # the last token of a path may go on in the url, so only what a separator ends is a literal
    closed = re.sub(r"[A-Za-z0-9]+$", "", path)
    return UrlRule(
        host + path,
        verdict,
        rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}",
        tuple(TOKEN.findall(host) + TOKEN.findall(closed.translate(_UPPER))),
        (1, len(host) + len(path)),
    )


def word_rule(verdict: str, word: str) -> UrlRule:
    """A word that stands between separators anywhere in host or path."""
    return UrlRule(f"*{word}*", verdict, rf"(\A|[^a-zA-Z0-9]){any_case(word)}([^a-zA-Z0-9]|\z)", (word,))


def part_rule(verdict: str, kind: str, part: str) -> UrlRule:
    """A label of a host, its last label, a directory or the ending of a path."""
    literal = re.escape(part)
    pattern = {"label": rf"\A([^/]*\.)?{literal}\.", "end": rf"\A[^/]*\.{literal}(/|\z)", "directory": rf"/{any_case(part)}(/|\z)", "ending": rf"\.{any_case(part)}\z"}[kind]
    return UrlRule(f"{kind} {part}", verdict, pattern, tuple(TOKEN.findall(part)))


#: An address of numbers in place of a name has no literal, so this rule is looked at for every url.
NUMERIC_HOST = UrlRule("numeric host", "block", r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?(/|\z)", ())
DEFAULT_RULES = (
    *(word_rule("block", w) for w in SPAM_WORDS),
    *(part_rule("block", kind, x) for kind, parts in (("label", AD_LABELS), ("end", DARK_ENDS), ("directory", PRIVATE_DIRECTORIES), ("ending", BINARY_ENDINGS)) for x in parts),
    NUMERIC_HOST,
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ://, up to / ? # or the end; then up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def token_counts(urls: DataFrame, url_col: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens stands. At most a row for each of these tokens comes back."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(url_col), F.lit(""))), "[^a-z0-9]+"))
    found = urls.select(F.explode(words).alias("token")).where(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in found.collect()}


def index_rules(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Each rule stands under its rarest token, the first in order on ties; under None if it has no token."""
    index: dict[str | None, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t)) if rule.tokens else None].append(i)
    return dict(index)


def filter_urls(
    pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", default_rules: Sequence[UrlRule] = DEFAULT_RULES, default: str = "allow"
) -> DataFrame:
    """One row for each row of `pages`: id_col, host, path, rule, verdict.

    All rules are indexed by their rarest token over the table's urls; a url's tokens fetch candidates, and only
    those run their regular expressions. Of matching `rules` the longest names rule and verdict. Where none matches,
    rule is null and the verdict is that of `default_rules` (block before allow), else `default`. The rules come from
    the caller, as a list on the driver, and are as large as that list whatever the table.

    A null url, or one without ://, has empty host and path, no rule and the verdict `default`. Repeated rows give
    repeated results; an empty table gives none. Other columns are not read.
    """
    both = [*rules, *default_rules]
    index = index_rules(both, token_counts(pages, url_col, (t for r in both for t in r.tokens)))

    def work(batch: pa.RecordBatch):
        compiled: dict[int, re.Pattern] = {}
        hosts, paths, names, verdicts = [], [], [], []
        for url in strings(batch.column(1)):
            host, path = split_url(url)
            whole, best, fallback = host + path, None, None
            for token in {None, *TOKEN.findall(whole.translate(_UPPER))}:
                for i in index.get(token, ()):
                    rule = both[i]
                    pattern = compiled.get(i) or compiled.setdefault(i, re.compile(rule.pattern.replace(r"\z", r"\Z")))
                    if not pattern.search(whole):
                        continue
                    if i >= len(rules):
                        fallback = rule.verdict if fallback != "block" else fallback
                    elif best is None or (rule.rank, rule.name) > (best.rank, best.name):
                        best = rule
            hosts.append(host)
            paths.append(path)
            names.append(best.name if best else None)
            verdicts.append(best.verdict if best else fallback or default)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], ["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, work, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
