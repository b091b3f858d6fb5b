"""License scan: an Aho-Corasick automaton over a text's words, and licence expressions.

One automaton holds notice phrases and the identifier tag.  It runs over the text's words joined
by single spaces, so a phrase is found where its words stand consecutively, whatever stands
between them.  After a tag the rest of the line is read as an expression: a shunting-yard parser
handles ``and``, ``or``, ``with``, ``+`` and brackets and evaluates whether permissive terms
suffice.  One pass over the rows, no shuffle.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, bounded_batches, texts_of, whole_numbers

# Phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases and the identifiers of their licences.
NOTICE_PHRASES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0-1.0",
    "common development and distribution license": "cddl",
    "dedicated to the public domain": "public-domain",
    "do what the fuck you want to public license": "wtfpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "microsoft public license": "ms-pl",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "open database license": "odbl-1.0",
    "python software foundation license": "psf-2.0",
    "sil open font license": "ofl-1.1",
    "this is free and unencumbered software": "unlicense",
    "this work is in the public domain": "public-domain",
    "zlib license": "zlib",
}
TAG = "spdx license identifier"
# Identifiers whose terms only ask for notices.
PERMISSIVE = frozenset(
    """0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear
    bsd-4-clause bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 curl ecl-2.0 fsfap ftl hpnd icu ijg isc libpng-2.0 libtiff mit mit-0
    mit-cmu ms-pl mulanpsl-2.0 ncsa ntp ofl-1.1 openssl pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby unicode-3.0 unicode-dfs-2016 unlicense
    upl-1.0 w3c wtfpl x11 zlib zpl-2.1""".split()
)
# Identifiers with further conditions.
RESTRICTED = frozenset(
    """agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later apsl-2.0 busl-1.1 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0
    cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3-only
    gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0-only
    lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception
    ms-rl odbl-1.0 osl-3.0 qpl-1.0 rpl-1.5 sleepycat sspl-1.0 vim""".split()
)
_OWN_NAME = re.compile(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+")
#: Strength of evidence: an identifier tag, a notice phrase, a base phrase.
WEIGHTS = {"tag": 1.0, "notice": 0.9, "base": 0.7}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions string, permissive boolean"
)
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I | re.ASCII)
_TERM = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.:\-]*\+?)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def is_licence(term: str) -> bool:
    """Whether a lower-cased term is a known identifier (a later version allowed by ``+``) or a reference to the author's own."""
    name = term.removesuffix("+")
    return name in PERMISSIVE or name in RESTRICTED or bool(_OWN_NAME.fullmatch(term))


def expression(source: str) -> tuple[str, list[str], bool] | None:
    """(postfix form, identifiers, permissive) of the longest licence expression that ``source`` starts with.

    ``with`` binds closest and takes any exception's name, then ``and``, then ``or``.  None if it starts
    with no expression: a word that is no known identifier ends the reading.  Time grows with the
    length read: the operators wait in a chain of which the longest valid reading keeps the end.
    """
    output: list[str] = []
    stack: tuple | None = None  # (operator or bracket, the one below)
    best: tuple[int, tuple | None] | None = None
    at, depth, operand, after = 0, 0, True, ""
    while m := _TERM.match(source, at):
        term, at = m[1], m.end()
        low = term.lower()
        if operand and term == "(" and after != "with":
            stack, depth = (term, stack), depth + 1
        elif operand and low not in _BINDS and (after == "with" or is_licence(low)):
            output.append(low)
            operand = False
        elif not operand and term == ")" and depth:
            while stack[0] != "(":
                output.append(stack[0])
                stack = stack[1]
            stack, depth = stack[1], depth - 1
        elif not operand and low in _BINDS and not (low == "with" and output[-1] in _BINDS):
            while stack and stack[0] != "(" and _BINDS[stack[0]] >= _BINDS[low]:
                output.append(stack[0])
                stack = stack[1]
            stack, operand = (low, stack), True
        else:
            break
        after = low
        if not operand and not depth:
            best = len(output), stack
    if best is None:
        return None
    form, stack = output[: best[0]], best[1]
    while stack:
        form.append(stack[0])
        stack = stack[1]
    values: list[bool] = []
    names: list[str] = []
    for term in form:
        if term in _BINDS:
            b, a = values.pop(), values.pop()
            # An exception only adds rights: the licence before it decides.
            values.append(a or b if term == "or" else a and b if term == "and" else a)
            if term == "with":
                names.pop()
        else:
            values.append(term.removesuffix("+") in PERMISSIVE)
            names.append(term)
    return " ".join(form), names, values[0]


@functools.lru_cache(2)
def automaton(phrases: tuple[tuple[str, str, str], ...]) -> ahocorasick.Automaton:
    """Over latin-1 views of UTF-8: a phrase is (words, label, kind)."""
    found: dict[str, list[tuple[int, str, str]]] = {}
    for words, label, kind in phrases:
        found.setdefault(f" {words} ", []).append((len(words) + 2, label, kind))
    a = ahocorasick.Automaton()
    for key, values in found.items():
        a.add_word(key, values)
    a.make_automaton()
    return a


def scan_text(text: str, phrases: tuple[tuple[str, str, str], ...]) -> tuple:
    """The result columns of one text, without its id."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    line = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    tagged, upto, spaces = False, 0, 0
    weights: dict[str, float] = {}
    for end, values in automaton(phrases).iter(line):
        for length, label, kind in values:
            if kind == "tag":
                tagged = True
                continue
            weights[label] = max(weights.get(label, 0.0), WEIGHTS[kind])
            labels.add(label)
            if kind == "base":
                start = end + 1 - length
                # Starts come in order but for overlaps of a few words.
                if start >= upto:
                    spaces, upto = spaces + line.count(" ", upto, start), start
                    at = spaces
                else:
                    at = spaces - line.count(" ", start, upto)
                n_base, base = n_base + 1, base | {label}
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    forms, allowed = [], []
    if tagged:
        for m in _TAGGED.finditer(text):
            if parsed := expression(m[1]):
                forms.append(parsed[0])
                labels.update(parsed[1])
                allowed.append(parsed[2])
                weights.update(dict.fromkeys(parsed[1], WEIGHTS["tag"]))
    # Independent evidence: the chance that not all of it errs.
    strength = 1.0 - math.prod(1.0 - weights[label] for label in sorted(weights))
    return (
        len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), strength,
        "; ".join(forms) or None, all(allowed) if allowed else None,
    )


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """One row per row of ``df``: places and labels of base phrases, all labels, evidence, expressions.

    Words count from 0.  ``score`` grows with the strength and number of the labels' evidence, 0 without any, 1 with an identifier tag;
    ``expressions`` are the tagged licence expressions in postfix form and ``permissive`` says
    whether permissive terms satisfy all of them.  A null or empty text has no words and no
    labels; repeated rows are scanned each; an empty table gives no rows; a very long text is scanned
    whole by one task; ids must be integers, a null one is kept; other columns are not read.
    """
    whole_numbers(df, id_col)
    bounded_batches(df.sparkSession)
    phrases = tuple((p, label, "base") for p, label in base.items())
    phrases += tuple((p, label, "notice") for p, label in notices.items()) + ((TAG, "", "tag"),)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(scan_text(t, phrases) for t in texts_of(batch.column(1))), strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=names)

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
