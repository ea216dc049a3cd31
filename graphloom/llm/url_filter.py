"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that may be sent to every task.
MOST_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """Regular expressions: `pattern` over the whole URL or, if there is a `path`, over the host, with `path` over the path.

    literals: tokens (runs of a-z and 0-9 after lower-casing) that every URL that fits contains as whole tokens.
    """

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    path: str | None = None


def site_rule(name: str, verdict: str) -> Rule:
    """`host/path`: the host or a subdomain of it, and a path that starts with this one."""
    host, _, path = name.partition("/")
    whole = _TOKEN.findall(f"/{path}".translate(_LOWER))
    if whole and path[-1:].translate(_LOWER).isalnum():
        whole.pop()  # the last token may go on in the URL
    literals = dict.fromkeys([*_TOKEN.findall(host.translate(_LOWER)), *whole])
    return Rule(name, rf"(?s:.*\.)?{re.escape(host.translate(_LOWER))}\Z", tuple(literals), verdict, re.escape(f"/{path}"))


#: Fixed values of the contract.
SITE_RULES = [
    site_rule("org/", "allow"),
    site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"),
    site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
]

#: Patterns for what no site rule decides: pages that repeat others or hold no text.
PATTERN_RULES = [
    Rule("session", r"[?&;](?:jsessionid|phpsessid|sid)=", (), "block"),
    Rule("tracking", r"[?&]utm_source=(?:spam|ads)\b", ("utm", "source"), "block"),
    Rule("print", r"[?&]print=(?:1|true|yes)\b", ("print",), "block"),
    Rule("calendar", r"/calendar/\d{4}/\d{1,2}\b", ("calendar",), "block"),
    Rule("login", r"/(?:user|account)?/?login\b", (), "block"),  # also /userlogin, whose token is not login
    Rule("cart", r"/cart(?:/|\?|$)", ("cart",), "block"),
    Rule("wp admin", r"/wp-admin/", ("wp", "admin"), "block"),
    *(Rule(f"file {x}", rf"\.{x}(?:[?#]|$)", (x,), "block") for x in ("jpg", "jpeg", "png", "gif", "svg", "mp3", "mp4", "zip", "gz", "exe", "pdf")),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rare_index(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Rules by the literal that the fewest URLs hold, ties by the literal; those without a literal under None."""
    index: dict[str | None, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.literals, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(key, []).append(i)
    return index


def literal_counts(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """How many URLs hold each literal of the rules; as many rows as literals, however many URLs."""
    literals = sorted({t for r in rules for t in r.literals})
    tokens = F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))
    held = F.array_intersect(tokens, F.lit(literals).cast("array<string>") if literals else F.array().cast("array<string>"))
    return {r["token"]: r["count"] for r in pages.select(F.explode(held).alias("token")).groupBy("token").count().collect()}


def judge(pages: DataFrame, site_rules: list[Rule] = SITE_RULES, pattern_rules: list[Rule] = PATTERN_RULES, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Return page_id, host, path, rule, verdict, pattern, n_tried for each row.

    The longest site rule that fits gives rule and verdict; else rule is null and the first pattern rule that fits gives
    the verdict (pattern names it), else `default`. Each token of a URL fetches the rules under it, and only those
    run; n_tried counts them. A null URL or one without `://` has an empty host and path, which no site rule fits.
    Repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    rules = [*site_rules, *pattern_rules]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} go to every task")
    index = rare_index(rules, literal_counts(pages, rules, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(r.pattern), None if r.path is None else re.compile(r.path)) for r in rules]
        for b in batches:
            out = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                tried = [*index.get(None, []), *(i for t in set(_TOKEN.findall((u or "").translate(_LOWER))) for i in index.get(t, []))]
                site, pattern = None, None
                for i in sorted(tried):
                    rule, (whole, start) = rules[i], compiled[i]
                    if start is None:
                        pattern = pattern or (rule if whole.search(u or "") else None)
                    elif start.match(path) and whole.match(host) and (site is None or len(rule.name) > len(site.name)):
                        site = rule
                decided = site or pattern
                out.append((host, path, site and site.name, decided.verdict if decided else default, pattern.name if pattern and not site else None, len(tried)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(),) * 5 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "pattern", "n_tried"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string, n_tried int")
