"""URL filter: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is written as in public filter lists: ``*`` any run, ``^`` a separator or the end,
a leading ``||`` a host name's label start, a leading ``@@`` an exception that allows.  Its
literal tokens are the alphanumeric runs that stand whole between separators; the one that is
rarest over all URLs indexes it.  A URL's tokens fetch candidate rules and only those run their
regular expressions.  The index is part of the tasks' closure; its size is that of the rule list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_numbers

#: (host, path, verdict): fixed values of the host rules.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Pattern rules for URLs that no host rule fits.
PATTERN_RULES = (
    "||blog.",
    "^utm_source=feed^",
    "||m.*/de/",
    "||ads.",
    "^track^",
    "^sponsored^",
    "@@||www.",
    "@@^page=2^",
)
SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string, candidates int"
_TOKEN = re.compile(r"[a-z0-9]+")
_SEP = r"(?:[^a-z0-9.%_-]|$)"


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://`` in lower case, then the path up to ``?`` or ``#``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0] if rest else ""
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


class Pattern:
    """A pattern rule: its expression over lower-cased URLs, and its whole literal tokens."""

    def __init__(self, rule: str):
        self.rule, self.verdict = rule, "allow" if rule.startswith("@@") else "block"
        body = lower_ascii(rule.removeprefix("@@"))
        anchored = body.startswith("||")
        body = body.removeprefix("||")
        parts = {"*": ".*", "^": _SEP}
        source = "".join(parts.get(c) or re.escape(c) for c in body)
        # A host anchor belongs to the first "://" of the URL, not to one inside its query.
        self.regex = re.compile((r"(?s:(?:(?!://).)*)://(?:[^/?#]*\.)?" if anchored else "") + source)
        self.find = self.regex.match if anchored else self.regex.search
        self.tokens = {
            m[0] for m in _TOKEN.finditer(body)
            if (m.start() or anchored) and m.end() < len(body) and body[m.start() - 1 : m.start()] != "*" and body[m.end()] != "*"
        }


def token_counts(df: DataFrame, url_col: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all rows: at most one count a token."""
    wanted = sorted(set(tokens))
    own = df.select(F.explode(F.array_distinct(F.split(F.lower(df[url_col]), "[^a-z0-9]+"))).alias("token")).where(F.col("token").isin(wanted))
    return dict.fromkeys(wanted, 0) | {r.token: r.n for r in own.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rarest_index(patterns: list[Pattern], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> rules that it fetches; rules without a whole token are under the empty string."""
    index: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url",
    host_rules: Iterable[tuple[str, str, str]] = HOST_RULES, pattern_rules: Iterable[str] = PATTERN_RULES, default: str = "allow",
) -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict, pattern (that decided), candidates (tried).

    The longest host rule that fits gives rule and verdict; else the pattern rules do, exceptions
    first, then blocks, then ``default``.  A null URL or one without ``://`` has an empty host and
    path, and no host rule; a null id is kept, repeated rows are judged each, an empty table gives
    no rows, and a very long URL is searched whole.  Only the id and URL columns are read.
    """
    whole_numbers(df, id_col)
    patterns = [Pattern(r) for r in pattern_rules]
    tokens = {t for p in patterns for t in p.tokens}
    index = rarest_index(patterns, token_counts(df, url_col, tokens) if tokens else {})
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for host, path, verdict in host_rules:
        by_host.setdefault(host, []).append((len(host + path), path, host + path, verdict))

    def decide(url: str | None) -> tuple:
        host, path = split_url(url)
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), ()) if path.startswith(r[1])]
        if fits:
            _, _, rule, verdict = max(fits)
            return host, path, rule, verdict, None, 0
        low = lower_ascii(url or "")
        tried = sorted({i for t in {*_TOKEN.findall(low), ""} for i in index.get(t, ())}, key=lambda i: (patterns[i].verdict, i))
        hit = next((patterns[i] for i in tried if patterns[i].find(low)), None)
        return host, path, None, hit.verdict if hit else default, hit.rule if hit else None, len(tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = list(zip(*map(decide, batch.column(1).to_pylist()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=names)

    return df.select(df[id_col].alias("page_id"), df[url_col].alias("url")).mapInArrow(run, SCHEMA)
