"""Licence scans: an automaton finds identifier tags and notice phrases, a parser evaluates licence expressions.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. One Aho-Corasick automaton holds
all phrases (names of licences and what their texts begin with), padded by spaces, and runs over the words joined by
single spaces, so that a phrase is found wherever its words stand one after the other. Behind a ``SPDX-License-Identifier`` tag stands an expression: it is read from the text
as it is, and a shunting-yard parser turns it into postfix order (WITH binds before AND, AND before OR), which gives its
labels, whether there is a choice, and its freedom: AND is as free as its less free side, OR as its freer side, as one may
choose, and WITH halves what its licence lacks. A broken expression gives the labels of the ids it names.

Score: 0 without finding; 0.4 with a phrase that only reserves rights; 0.6 and 0.1 more for every further label, up to
0.9, with notices; 1 with an expression that parses. ``freedom`` is the least of the text's expressions, from 0 to 1, null
if none parses: that of the heaviest duty of a licence's family (``DUTIES``, ``FAMILIES``; an unknown id counts ``UNKNOWN``).

Defined results: null or empty text has no words, no labels (empty strings), null first and last word and freedom, score 0;
repeated rows are scanned one by one; extra columns are ignored. One scan and one Arrow map, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices by which common licences are known, and their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license": "gpl-notice",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-notice",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "public domain": "public-domain",
    "apache licence": "apache",
    "mit licence": "mit",
    "bsd licence": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "postgresql license": "postgresql",
    "python software foundation license": "psf",
    "academic free license": "afl",
    "artistic license": "artistic",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "mozilla public license version 2 0": "mpl-2.0",
    "sil open font license": "ofl",
    "gnu general public licence": "gpl-notice",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu free documentation license": "gfdl",
    "european union public licence": "eupl",
    "open software license": "osl",
    "open database license": "odbl",
    "open data commons attribution license": "odc-by",
    "server side public license": "sspl",
    "elastic license": "elastic",
    "business source license": "busl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
}
# What the texts of common licences, and the notices that they ask for, begin with.
OPENINGS = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission is hereby granted free of charge to any person or organization obtaining a copy": "bsl-1.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission to use copy modify and distribute this software and its documentation for any purpose": "hpnd",
    "this software is provided as is without any express or implied warranty": "zlib",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "this library is free software you can redistribute it and or modify it": "lgpl",
    "this source code form is subject to the terms of the mozilla public": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "this work is licensed under a creative commons": "cc-notice",
}
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
_ID = re.compile(r"[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Endings of comments that may follow a tag in its line.
_COMMENT_END = re.compile(r"\*/|-->|#}|\"\"\"|'''")
#: How freely what stands under a licence may be used, by the heaviest duty that it lays on users.
DUTIES = {"none": 1.0, "notice": 0.9, "share changed files": 0.7, "share the whole work": 0.5, "share what is served": 0.4, "restricted use": 0.2, "use by agreement": 0.1}
# Beginnings of licence ids (all versions and variants follow) by that duty; the longest that fits counts.
FAMILIES = {
    "none": "0bsd cc-pddc cc0 mit-0 pddl unlicense wtfpl",
    "notice": "aal adsl afl apache beerware blueoak bsd bsl-1.0 cc-by cdla-permissive cnri curl ecl efl fsfap ftl hpnd icu ijg imagemagick info-zip intel isc "
    "libpng libtiff linux-openib mit ms-pl mulanpsl naist ncsa nist ntp odc-by oldap openssl php postgresql psf pil python ruby saxpath sgi-b tcl unicode upl "
    "vim w3c x11 xfree86 xnet zend zlib zpl",
    "share changed files": "apsl artistic cddl cecill-c clartistic cpl eclipse epl erlpl ipl lgpl lppl lpl mpl ms-rl nasa npl nokia ofl sissl spl",
    "share the whole work": "cc-by-sa cdla-sharing cecill eupl gfdl gpl odbl qpl sleepycat",
    "share what is served": "agpl cpal osl rpl",
    "restricted use": "cc-by-nc cc-by-nd elastic json polyform sspl",
    "use by agreement": "busl",
}
FREEDOM = {i: DUTIES[duty] for duty, ids in FAMILIES.items() for i in ids.split()}
UNKNOWN = 0.3


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the ids and operators of a licence expression in postfix order; None if it is broken."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at, token = m.end(), m[1]
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(low)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def summary(order: list[str]) -> tuple[frozenset[str], frozenset[str]] | None:
    """(licences of some choice, licences of every choice), without listing the choices; they differ if there are several.
    None if WITH joins more than two ids."""
    stack: list[tuple[frozenset[str], frozenset[str]]] = []
    for token in order:
        if token not in _RANK:
            stack.append((frozenset([token]),) * 2)
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            if a[0] != a[1] or b[0] != b[1] or len(a[0]) != 1 or len(b[0]) != 1:
                return None
            stack.append((frozenset([f"{min(a[0])}-with-{min(b[0])}"]),) * 2)
        else:
            stack.append((a[0] | b[0], a[1] | b[1] if token == "and" else a[1] & b[1]))
    return stack[0]


def freedom(order: list[str]) -> float:
    """How free an expression in postfix order is, from 0 to 1."""
    stack: list[float] = []
    for token in order:
        if token not in _RANK:
            fits = [k for k in FREEDOM if token.startswith(k)]
            stack.append(FREEDOM[max(fits, key=len)] if fits else UNKNOWN)
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(min(a, b) if token == "and" else max(a, b) if token == "or" else (1 + a) / 2)
    return stack[0]


def expression_labels(expression: str) -> tuple[set[str], float | None]:
    """(labels, freedom): ``spdx:id`` of every licence named, ``spdx:choice`` where one of several may be taken; no freedom
    if the expression is broken."""
    end = _COMMENT_END.search(expression)
    text = (expression[: end.start()] if end else expression).strip()
    order = postfix(text)
    if not order:
        ids = {t.lower() for t in _ID.findall(text)} - _RANK.keys()
        return {f"spdx:{i}" for i in ids if re.search("[a-z]", i)}, None
    found = summary(order)
    if found is None:
        return {f"spdx:{t}" for t in order if t not in _RANK}, freedom(order)
    return {f"spdx:{i}" for i in found[0]} | ({"spdx:choice"} if found[0] != found[1] else set()), freedom(order)


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in [*BASE, *NOTICES, *OPENINGS, TAG]:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float, float | None]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, freedom)."""
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        starts, base, own, tagged = [], set(), set(), False
        spaces = counted = 0
        for end, phrase in self.automaton.iter(line):
            begin = end - len(phrase) - 1
            if phrase in BASE:
                # Words before the phrase: the spaces up to and with the one before it, less the first.
                if begin >= counted:
                    spaces, counted = spaces + line.count(" ", counted, begin + 1), begin + 1
                    start = spaces - 1
                else:
                    start = line.count(" ", 0, begin + 1) - 1
                starts.append(start)
                base.add(BASE[phrase])
            elif phrase != TAG:
                own.add(NOTICES.get(phrase) or OPENINGS[phrase])
            else:
                tagged = True
        free: list[float] = []
        if tagged:
            for expression in _TAG.findall(text):
                labels, how = expression_labels(expression)
                own |= labels
                free += [] if how is None else [how]
        labels = base | own
        if free:
            score = 1.0
        elif labels - {"reserved"}:
            score = min(0.9, 0.6 + 0.1 * (len(labels) - 1))
        else:
            score = 0.4 if labels else 0.0
        join = lambda x: ",".join(sorted(x))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(labels), round(score, 6), min(free, default=None)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: one row of SCHEMA for each row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
