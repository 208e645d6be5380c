"""License scan: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

A text is read as bytes: A-Z are lowered and every byte outside 0-9, a-z and 0x80-0xFF ends a word. The words,
joined by single spaces, are searched for notice phrases and for the identifier tag in one automaton pass.
Where the tag stands, the expression behind it in the original line is read: the leading run of names joined by or, and,
with or a slash, with brackets anywhere. Every licence it names becomes a label, also where the brackets do not match;
the name behind a `with` is an exception and no label. A well-formed expression (or < and < with) is parsed and
evaluated: it is open if one of its choices needs permissive licences only. Notices that stand in one sentence, joined by
such words ("under the MIT license or the Apache License, version 2"), are an expression of the same kind.

Defined results: null or empty text has no words, no places, null first and last words, empty labels, score 0; an
empty table gives no rows. Very long texts are scanned whole. Ties: places at the same word count once per phrase; of
notices that overlap the longest is part of an expression, and all are labels. Repeated rows are scanned one by one;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, bounded_batches, table

#: Fixed base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed further notices of the method.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
#: Fixed: identifiers of licences that ask for no more than a notice, and the labels of notices that mean them.
PERMISSIVE = frozenset(
    "0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause "
    "bsl-1.0 cc-by-4.0 cc0-1.0 curl ecl-2.0 fsfap isc mit mit-0 mit-modern-variant ms-pl ncsa ofl-1.1 openssl php-3.01 postgresql psf-2.0 python-2.0 unicode-3.0 "
    "unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1 apache-2 bsd bsl".split()
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, open boolean"

#: A-Z lowered; bytes to lower-case word bytes or spaces.
LOWERED = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))
WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: The tag and the rest of its line; the run of names behind it; exceptions; names. The same patterns serve in SQL.
_TAG_LINE = r"(?:^|[^0-9a-z\x{80}-\x{10FFFF}])spdx-license-identifier:[ \t]*([^\r\n]*)"
_NAME = r"[a-z0-9][a-z0-9.+-]*"
_RUN = rf"^[ \t()]*{_NAME}(?:[ \t()]*/[ \t()]*{_NAME}|[ \t()]+(?:or|and|with)[ \t()]+{_NAME})*[ \t()]*"
_EXCEPTION = rf"[ \t()]with[ \t()]+{_NAME}"
_TAG_OF = re.compile(_TAG_LINE.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010FFFF"))
_RUN_OF, _EXCEPTION_OF, _NAMES_OF = re.compile(_RUN), re.compile(_EXCEPTION), re.compile(_NAME)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_SLASH = re.compile(r"(?<=[A-Za-z0-9.+)-])[ \t]*/[ \t]*(?=[(A-Za-z0-9])")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Words that may stand between two notices of one sentence, beside or, and, with.
_BETWEEN = frozenset("either the a an any under of terms at your option license licence licenses licensed version later both".split())


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a licence expression, prose behind it left out; None where it is malformed."""
    return parse_tokens(_TOKEN.findall(_SLASH.sub(" or ", text)))


def parse_tokens(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form by shunting-yard."""
    output: list[str] = []
    stack: list[str] = []
    want_name = True
    for token in tokens:
        low = token.lower()
        if low in _RANK:
            if want_name:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                output.append(stack.pop())
            stack.append(low)
            want_name = True
        elif token == "(":
            if not want_name:
                return None
            stack.append(token)
        elif token == ")":
            if want_name:
                return None
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not want_name:
                break  # prose after the expression
            output.append(low)
            want_name = False
    while stack:
        if stack[-1] == "(":
            return None
        output.append(stack.pop())
    return output if output and not want_name else None


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """(licences named, whether some choice needs permissive licences only). An exception keeps its licence's answer."""
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left[0], left[1]))
            else:
                stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1])))
        else:
            stack.append(({token}, token.rstrip("+") in PERMISSIVE))
    return stack[0]


def automaton(base=BASE, notices=NOTICES) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    labels: dict[str, list] = {}
    for phrase, label in base.items():
        labels.setdefault(phrase, [None, None])[0] = label
    for phrase, label in notices.items():
        labels.setdefault(phrase, [None, None])[1] = label
    labels.setdefault(TAG, ["", ""])
    for phrase, (first, second) in labels.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, None if phrase == TAG else first, second, phrase == TAG))
    found.make_automaton()
    return found


def tagged_names(line: str) -> tuple[list[str], str]:
    """(licences, run) of the lower-case rest of a tag's line: all names in the leading run, but not the exceptions."""
    run = _RUN_OF.match(line)
    if run is None:
        return [], ""
    return [x for x in _NAMES_OF.findall(_EXCEPTION_OF.sub(" ", run[0])) if x not in _RANK], run[0]


def sentences(joined: str, places: list[tuple[int, int, str]]) -> list[list[str]]:
    """Expressions of notices, as tokens. places: (first, end, label) of notices in the joined words."""
    longest: list[tuple[int, int, str]] = []
    for a, b, label in sorted(places, key=lambda p: (p[0], -p[1])):
        if not longest or a >= longest[-1][1] - 1:
            longest.append((a, b, label))
    found: list[list[str]] = []
    end = None
    for a, b, label in longest:
        # Notices share the space between them.
        between = joined[end:a].split() if end is not None and a - end < 80 else None
        joins = [w for w in between or () if w in _RANK]
        if joins and all(w in _RANK or w in _BETWEEN for w in between):
            found[-1] += [joins[0], label]
        else:
            found.append([label])
        end = b
    return found


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, open) of one text."""
    words = text.translate(WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, labels, tagged = set(), set(), False
    n_base, first, last = 0, None, None
    counted = at_word = 0
    starts, places = [], []
    for end, (length, base_label, label, tag) in machine.iter(joined):
        start = end - length + 1
        if base_label:
            base.add(base_label)
            n_base += 1
            starts.append(start)
        if label:
            labels.add(label)
        if base_label or label:
            places.append((start, end + 1, label or base_label))
        tagged |= tag
    if starts:
        starts.sort()
        for start in (starts[0], starts[-1]):
            at_word += joined.count(" ", counted, start + 1)
            counted = start + 1
            first, last = (at_word - 1 if first is None else first), at_word - 1
    free, named = None, False
    if tagged:
        for line in _TAG_OF.findall(text.translate(LOWERED).decode("utf-8", "replace")):
            names, run = tagged_names(line)
            labels |= set(names)
            named |= bool(names)
            rpn = parse_expression(run)
            if rpn:
                is_open = evaluate(rpn)[1]
                free = is_open if free is None else free and is_open
    labels |= base
    score = 1.0 if named else 0.9 if n_base else 0.7 if labels else 0.0
    if free is None and places and not named:
        free = all(evaluate(parse_tokens(tokens))[1] for tokens in sentences(joined, places))
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, free


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row for each document; see the module's text for the columns."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "open"]
        for batch in batches:
            rows = [scan(x.as_buffer().to_pybytes() if x.is_valid else b"", machine) for x in batch.column(1).cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("open")


def _oracle() -> str:
    """The same in SQL over word lists and the tag's patterns."""

    def starts(phrase: str) -> str:
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        return f"list_filter(range(1, greatest(len(w) - {len(words) - 2}, 1)), lambda i: {same})"

    base = ", ".join(f"list_transform({starts(p)}, lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in BASE.items())
    more = ", ".join(f"CASE WHEN len({starts(p)}) > 0 THEN ['{label}'] ELSE [] END" for p, label in NOTICES.items())
    runs = f"list_transform(regexp_extract_all(low, '{_TAG_LINE}', 1), lambda x: regexp_replace(regexp_extract(x, '{_RUN}'), '{_EXCEPTION}', ' ', 'g'))"
    names = f"list_filter(flatten(list_transform({runs}, lambda x: regexp_extract_all(x, '{_NAME}'))), lambda x: x NOT IN ('or', 'and', 'with'))"
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
e AS (SELECT doc_id, low, list_filter(string_split_regex(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT doc_id, len(w) AS n_words, flatten([{base}]) AS b, flatten([{more}]) AS m, {names} AS t FROM e),
g AS (SELECT *, list_sort(list_distinct(list_transform(b, lambda x: x.label))) AS bl FROM f),
h AS (SELECT *, list_sort(list_distinct(list_concat(bl, m, t))) AS al FROM g)
SELECT doc_id, n_words, len(b) AS n_base, list_min(list_transform(b, lambda x: x.at)) AS first_word, list_max(list_transform(b, lambda x: x.at)) AS last_word,
array_to_string(bl, ',') AS base_labels, array_to_string(al, ',') AS labels, CASE WHEN len(t) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.9 WHEN len(al) > 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM h"""


ORACLE = _oracle()
