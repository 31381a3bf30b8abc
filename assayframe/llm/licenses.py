"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser reads the expressions.

Text is normalised to its words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z in lower case) joined by one space, and one automaton
finds all phrases in one pass. An identifier tag's expression (`MIT OR (Apache-2.0 AND BSD-3-Clause)`) is read from the text
itself, turned into postfix order, and evaluated to its labels and to the share of permissive choice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import LOWER, small_batches

NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and the label each stands for.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0", "apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge": "mit", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "lesser general public license": "lgpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "isc license": "isc", "boost software license": "bsl", "eclipse public license": "epl",
    "all rights reserved": "proprietary", "public domain": "public-domain", "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
# Families by the start of an identifier, and how freely each may be used (1: permissive, 0: closed).
FAMILIES = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "zlib": 1.0,
            "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "proprietary": 0.0}
TAG_LINE = re.compile(r"spdx[^a-z0-9\n]{1,3}license[^a-z0-9\n]{1,3}identifier\s*[:=]?\s*([^\n\r]*)", re.I | re.A)
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+_-]*", re.A)
RANK = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, TAG: ""}.items():
        found.add_word(f" {phrase}", (phrase, label, phrase in BASE))
    for phrase, label in BASE.items():
        found.add_word(f" {phrase}", (phrase, label, True))
    found.make_automaton()
    return found


def freedom(label: str) -> float:
    """How freely a licence may be used, by the longest family its identifier starts with; unknown ones count half."""
    best = max((f for f in FAMILIES if label == f or label.startswith((f + "-", f + "+"))), key=len, default=None)
    return FAMILIES[best] if best else 0.5


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: `with` binds before `and` before `or`; reading stops where the expression ends."""
    out, ops, need = [], [], True
    for t in tokens:
        k = t.lower()
        if k == "(":
            if not need:
                break
            ops.append(k)
        elif k == ")":
            if need or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif k in RANK:
            if need:
                break
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[k]:
                out.append(ops.pop())
            ops.append(k)
            need = True
        else:
            if not need:
                break
            out.append(k)
            need = False
    return out + [x for x in reversed(ops) if x != "("]


def evaluate(tokens: list[str]) -> tuple[frozenset[str], float]:
    """Labels of a postfix expression and its freedom: `or` lets choose the freer, `and` binds to the stricter, `with` keeps
    the licence and adds the exception to its label. Operators without both sides are dropped."""
    stack: list[tuple[frozenset[str], float]] = []
    for t in tokens:
        if t not in RANK:
            stack.append((frozenset([t]), freedom(t)))
        elif len(stack) > 1:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((frozenset(f"{p}-with-{q}" for p in a for q in b), x))
            else:
                stack.append((a | b, max(x, y) if t == "or" else min(x, y)))
    labels = frozenset().union(*[a for a, _ in stack]) if stack else frozenset()
    return labels, min([x for _, x in stack], default=0.0)


class Scanner:
    def __init__(self):
        self.phrases = automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
        low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        line = b" " + NOT_WORD.sub(b" ", low).strip(b" ")
        n_words = line.count(b" ") if len(line) > 1 else 0
        flat = line.decode("utf-8", "surrogatepass") + " "
        n_base, first, last, base, labels, grades, tagged = 0, None, None, set(), set(), [], False
        word, read = -1, 0  # number of the last word begun before `read`
        for end, (phrase, label, is_base) in self.phrases.iter(flat):
            if flat[end + 1] != " ":
                continue
            if phrase == TAG:
                tagged = True
                continue
            labels.add(label)
            grades.append(freedom(label))
            if is_base:
                word, read = word + flat.count(" ", read, end + 1), end + 1  # hits come by their end
                place = word - phrase.count(" ")
                n_base += 1
                base.add(label)
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
        if tagged:
            for m in TAG_LINE.finditer(text):
                found, grade = evaluate(postfix(TOKEN.findall(m[1])))
                labels |= found
                if found:
                    grades.append(grade)
        return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(min(grades)) if grades else 0.0


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: the columns of `SCHEMA` after doc_id. score: how freely the stated licences together allow use
    (the strictest counts), 0 without any. Null texts are empty; empty label lists are empty strings; repeated rows give repeated
    results; other columns are ignored."""

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner()
        kinds = {"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"}
        for texts in parts:
            yield pd.DataFrame([s.scan(t) for t in texts], columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype(kinds)

    return small_batches(docs).select("doc_id", run(F.col("text")).alias("x")).select("doc_id", "x.*")
