"""License scans: notices found by an Aho-Corasick automaton, licence expressions evaluated by a shunting-yard parser.

A text is lower-cased (A-Z) and its words, runs of ASCII letters, digits and non-ASCII characters, are joined by single spaces.
The automaton holds all phrases with a space at either end and passes once over that, so it finds every place where
a phrase's words stand consecutively, overlapping ones too. Where it finds an identifier tag, the expression behind
the tag is taken from the text itself, up to the end of its line, and parsed: `with` binds before `and` before `or`.
An expression's value is how freely the text may be used: `and` takes the smaller value, `or` the larger, and an
exception after `with` lifts half of what is restricted.

score: 0 if nothing is found, or else the least of the values of phrases and expressions (all notices apply), at
least 0.05. Expressions that don't parse add the label `spdx:invalid` and the least value.

Null and empty texts give no words, empty labels and score 0. Every row gives one row; other columns are ignored.
Texts are scanned whole, one at a time; nothing but the automaton (its size is fixed) is held beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches

#: Phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrase, label and how freely the text may be used.
NOTICES = {
    "mit license": ("mit", 0.95),
    "apache license": ("apache", 0.9),
    "general public license": ("gpl", 0.4),
    "lesser general public license": ("lgpl", 0.5),
    "affero general public license": ("agpl", 0.3),
    "bsd license": ("bsd", 0.95),
    "mozilla public license": ("mpl", 0.6),
    "eclipse public license": ("epl", 0.6),
    "isc license": ("isc", 0.95),
    "creative commons": ("cc", 0.7),
    "public domain": ("public-domain", 1.0),
    "permission is hereby granted free of charge": ("mit-notice", 0.95),
    "redistribution and use in source and binary forms": ("bsd-notice", 0.95),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.1),
}
TAG = "spdx license identifier"
#: The start of a licence's short name and its value.
FAMILIES = {"mit": 0.95, "apache": 0.9, "bsd": 0.95, "isc": 0.95, "0bsd": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.7, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.4, "agpl": 0.3}
UNKNOWN, LEAST = 0.2, 0.05
_NOT_WORD = bytes(b if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Dijkstra's shunting-yard: operands and operators in postfix order; None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(" or token not in _RANK and token != ")":
            if not wants_operand:
                return None
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                wants_operand = False
            continue
        if wants_operand:
            return None
        if token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
            continue
        while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
            out.append(stack.pop())
        stack.append(token)
        wants_operand = True
    if wants_operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """The licences that an expression names and its value."""
    order = postfix(expression)
    if order is None:
        return None
    names: set[str] = set()
    values: list[tuple[float, str | None]] = []
    for token in order:
        if token in _RANK:
            (right, exception), (left, name) = values.pop(), values.pop()
            if token == "with":
                if exception is None or name is None:
                    return None
                names.discard(exception)
                values.append((left + (1 - left) / 2, None))
            else:
                values.append((min(left, right) if token == "and" else max(left, right), None))
        else:
            family = max((f for f in FAMILIES if token.startswith(f)), key=len, default=None)
            names.add(token)
            values.append((FAMILIES[family] if family else UNKNOWN, token))
    return names, values[0][0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = raw.translate(_NOT_WORD).split(b" ")
    words = [w for w in words if w]
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    labels, base_labels, starts, values = set(), set(), [], []
    tagged = False
    for end, phrase in phrases.iter(flat):
        if phrase == TAG:
            tagged = True
            continue
        label, value = NOTICES[phrase]
        labels.add(label)
        values.append(value)
        if phrase in BASE:
            base_labels.add(BASE[phrase])
            starts.append(end - len(phrase) - 1)
    for found in _TAG_LINE.finditer(raw) if tagged else ():
        result = evaluate(found[1].decode("utf-8", "replace"))
        labels |= {f"spdx:{name}" for name in result[0]} if result else {"spdx:invalid"}
        values.append(result[1] if result else LEAST)
    first = last = None
    if starts:
        first, last = flat.count(" ", 0, min(starts)), flat.count(" ", 0, max(starts))
    score = max(LEAST, min(values)) if values else 0.0
    return len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        for batch in text_batches(batches, text):
            columns = zip(*(scan(t.as_py(), phrases) for t in batch.column(text)), strict=True)
            yield pa.record_batch([batch.column(id), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id, *names])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(rows, f"{id} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
