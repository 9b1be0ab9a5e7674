"""License scan: an Aho-Corasick automaton finds licence names, notice phrases and
identifier tags in whole texts; a shunting-yard parser evaluates the and/or/with
expressions that stand behind the tags.

Null and empty texts have no words, no places and a score of 0. One narrow map, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlake.llm.common import texts

# The base names and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases as word sequences, with label and weight of evidence.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "released under the mit license": ("mit", 0.9),
    "licensed under the mit license": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.7),
    "boost software license": ("bsl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "creative commons attribution": ("cc", 0.9),
    "licensed under cc by": ("cc", 0.9),
    "zlib license": ("zlib", 0.7),
    "this software is provided as is without any express or implied warranty": ("zlib", 0.6),
    "permission to use copy modify and or distribute this software for any purpose with or without fee": ("isc", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "neither the name of the copyright holder nor the names of its contributors": ("bsd", 0.9),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", 0.98),
    "made available under the terms of the eclipse public license": ("epl", 0.98),
    "cc0 1 0 universal": ("cc0", 0.95),
    "creative commons zero": ("cc0", 0.9),
    "all rights reserved": ("proprietary", 0.3),
}
BASE_WEIGHT, TAG_WEIGHT, CHOICE_WEIGHT = 0.7, 0.98, 0.9  # the last: a tag whose choices have no licence in common
TAG = "spdx license identifier"

# First part of an identifier -> label; others are labelled by the identifier itself.
FAMILIES = ("agpl", "lgpl", "gpl", "mit", "apache", "bsd", "0bsd", "mpl", "epl", "isc", "bsl", "unlicense", "cc0", "cc", "zlib")
_COPYLEFT = {"gpl": 3, "agpl": 4, "lgpl": 2, "mpl": 2, "epl": 2}

# Every ASCII character outside 0-9a-z becomes a blank, A-Z lower case; other bytes stay.
_WORDS = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
# the value may stand on the next line, behind comment marks
_TAG_LINE = re.compile(r"spdx[^0-9a-z\n]{1,3}license[^0-9a-z\n]{1,3}identifier[^\S\n]*:?[\s*#/;-]*([^\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = ("id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, expressions array<string>, in_force string, restrictiveness int, "
          "spans array<struct<label:string,kind:string,word:bigint,n_words:int>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def known(identifier: str) -> bool:
    """A licence of a listed family, or one that a document defines itself."""
    low = identifier.lower()
    return low.startswith(("licenseref-", "documentref-")) or label_of(low) in FAMILIES


def label_of(identifier: str) -> str:
    low = identifier.lower()
    return next((f for f in FAMILIES if low == f or low.startswith(f + "-")), low)


def parse(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order; None if it isn't one.

    Reads the longest well-formed start, so prose after an expression is no error. Operands are
    known licences, but for what stands behind ``with``."""
    out: list[str] = []
    ops: list[str] = []
    best: list[str] | None = None
    want = True  # an operand comes next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if want and token == "(":
            ops.append(token)
        elif want and token != ")" and low not in _PRECEDENCE and (ops[-1:] == ["with"] or known(token)):
            out.append(token)
            want = False
        elif not want and low in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            want = True
            continue
        elif not want and token == ")" and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            break
        if not want and "(" not in ops:
            best = out + ops[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[set[str], set[str], int]:
    """(labels named, labels in force under every choice, restrictiveness of the freest choice).

    ``and`` joins duties, ``or`` leaves a choice, ``with`` keeps its left side's licence."""
    stack: list[tuple[set[str], set[str], int]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            label = label_of(token.rstrip("+"))
            stack.append(({label}, {label}, _COPYLEFT.get(label, 1)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        elif token == "and":
            stack.append((left[0] | right[0], left[1] | right[1], max(left[2], right[2])))
        else:
            stack.append((left[0] | right[0], left[1] & right[1], min(left[2], right[2])))
    return stack[-1]


def automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str, float]]] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    found.setdefault(TAG, []).append(("tag", "", TAG_WEIGHT))
    a = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, meanings))
    a.make_automaton()
    return a


def scan_text(a: ahocorasick.Automaton, text: str | None) -> tuple:
    words = words_of(text)
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    spans, expressions, unsure, base, labels = [], [], 1.0, [], set()
    read = at = 0  # words counted up to a character
    tagged, in_force, duty = False, set(), None
    for end, (size, n, meanings) in a.iter(line):
        start = end - size + 1
        if start + 1 >= at:
            read += line.count(" ", at, start + 1)
        else:  # a longer phrase that began earlier
            read -= line.count(" ", start + 1, at)
        at = start + 1
        for kind, label, weight in meanings:
            if kind == "tag":
                tagged = True
                spans.append((None, kind, read - 1, n))
                continue
            spans.append((label, kind, read - 1, n))
            labels.add(label)
            unsure *= 1 - weight
            if kind == "base":
                base.append((read - 1, label))
    if tagged:
        for m in _TAG_LINE.finditer(text):
            postfix = parse(m[1])
            if postfix:
                named, binding, freest = evaluate(postfix)
                labels |= named
                in_force |= binding
                duty = max(duty or 0, freest)
                unsure *= 1 - (TAG_WEIGHT if binding else CHOICE_WEIGHT)
                expressions.append(" ".join(postfix))
    at_words = [w for w, _ in base]
    return (len(words), len(base), min(at_words, default=None), max(at_words, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1 - unsure, expressions, ",".join(sorted(in_force)), duty,
            [dict(zip(("label", "kind", "word", "n_words"), s)) for s in spans])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the counts, labels, score, the postfix form of each
    tag's expression, the labels in force under every choice its tags leave, the restrictiveness of
    the freest choice (1 free to 4, the strictest tag's; null without tags) and every span found
    (label, kind, first word, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            for start, values in texts(batch.column(1)):
                cols = list(zip(*(scan_text(a, t) for t in values)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(
                    pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64()), ("n_words", pa.int32())]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(values)), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                     "expressions", "in_force", "restrictiveness", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
