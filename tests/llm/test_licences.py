import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from volumetra.llm.licences import BASE, FAMILIES, FREEDOM, NOTICES, OPENINGS, Scanner, expression_labels, freedom, postfix, scan_licences


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 0x7F:
            word += c
        elif word:
            words.append(word)
            word = ""
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force():
    rng, scanner = random.Random(4), Scanner()
    vocabulary = ["cc", "by", "CC", "BY", "general", "Public", "license", "all", "rights", "reserved", "é", "xall", "nc", "mit"]
    for _ in range(500):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ". ", "\n", "", "/"]) for _ in range(rng.randrange(25)))
        got = scanner.scan(text)
        assert got[:5] == brute(text), text
        assert set(got[4].split(",")) - {""} <= set(got[5].split(","))
        assert 0 <= got[6] <= 1


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert Scanner().scan(text)[:5] == brute(text)


def choices(order):
    """The sets of licences of which one has to be met; None if WITH joins more than two ids."""
    stack = []
    for token in order:
        if token not in ("and", "or", "with"):
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            if len(a) != 1 or len(b) != 1 or len(a[0]) != 1 or len(b[0]) != 1:
                return None
            stack.append([frozenset([f"{min(a[0])}-with-{min(b[0])}"])])
        else:
            stack.append(list(dict.fromkeys(a + b if token == "or" else [x | y for x in a for y in b])))
    return stack[0]


def test_expressions():
    assert postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert postfix("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "or", "gpl-2.0", "classpath-exception-2.0", "with", "and"]
    for broken in ("", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT Apache", "()", "MIT ? X"):
        assert postfix(broken) is None
    assert choices(postfix("A AND (B OR C)")) == [frozenset("ab"), frozenset("ac")]
    assert choices(postfix("(A AND B) WITH C")) is None
    assert expression_labels("MIT OR GPL-2.0 WITH x */") == ({"spdx:mit", "spdx:gpl-2.0-with-x", "spdx:choice"}, 0.9)
    assert expression_labels("MIT OR") == ({"spdx:mit"}, None)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "# SPDX-License-Identifier: MIT OR Apache-2.0\nAll rights reserved."), (4, "x " * 50_000 + "cc-by"), (4, "x " * 50_000 + "cc-by"), (5, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, labels string")
    got = sorted((tuple(r) for r in scan_licences(docs).collect()), key=lambda r: r[0])
    assert got[0] == (1, 0, 0, None, None, "", "", 0.0, None) and got[1][1:] == got[0][1:]
    assert got[2][5:] == ("reserved", "reserved,spdx:apache-2.0,spdx:choice,spdx:mit", 1.0, 0.9)
    assert got[3] == got[4] == (4, 50_002, 1, 50_000, 50_000, "cc-by", "cc-by", 0.6, None)
    assert got[5][6] == "cc-by,cc-by-nc"
    assert scan_licences(docs.limit(0)).count() == 0


def test_long_expressions_keep_choice_and_with():
    text = " AND ".join(f"(A{i} OR B{i})" for i in range(40)) + " AND X WITH Y"
    labels, free = expression_labels(text)
    assert free is not None and labels == {f"spdx:{x}{i}" for i in range(40) for x in "ab"} | {"spdx:x-with-y", "spdx:choice"}


def test_labels_against_listed_choices():
    rng = random.Random(9)
    for _ in range(500):
        text = "A"
        for _ in range(rng.randrange(5)):
            text = f"({text}) {rng.choice(['AND', 'OR'])} ({rng.choice('ABC')} {rng.choice(['AND', 'OR', 'WITH'])} {rng.choice('ABC')})"
        sets = choices(postfix(text))
        want = {f"spdx:{x}" for s in sets for x in s} | ({"spdx:choice"} if len(sets) > 1 else set())
        assert expression_labels(text)[0] == want, text


def test_freedom_is_the_least_duty_and_the_best_choice():
    of = lambda text: freedom(postfix(text))
    assert of("MIT") == of("MIT OR GPL-3.0-only") == 0.9 and of("MIT AND GPL-3.0-only") == 0.5
    assert of("AGPL-3.0 AND (MIT OR X)") == 0.4 and of("CC-BY-SA-4.0") == 0.5 and of("CC-BY-4.0") == 0.9 and of("Who-Knows") == 0.3
    assert of("GPL-2.0 WITH Classpath-exception-2.0") == 0.75
    assert Scanner().scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0")[7] == 0.5


def test_long_runs_of_blanks_take_linear_time():
    start = time.time()
    blanks = " " * 200_000
    Scanner().scan(f"SPDX-License-Identifier: MIT{blanks}x{blanks}?{blanks}*/ y")
    Scanner().scan(f"SPDX-License-Identifier:{blanks}:{blanks}")
    Scanner().scan(f"SPDX-License-Identifier{blanks}" * 5)
    assert time.time() - start < 1


def test_licence_texts():
    scan = lambda t: Scanner().scan(t)[5:7]
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software") == ("mit", 0.6)
    assert scan("Redistribution and use in source and binary forms, with or without modification,") == ("bsd", 0.6)
    assert scan("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee") == ("isc", 0.6)
    assert scan("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License") == ("gpl,gpl-notice", 0.7)
    assert scan("Creative Commons Attribution-ShareAlike 4.0")[0] == "cc-by-sa,cc-notice"
    assert scan("Redistribution and use of these forms") == ("", 0.0)
    for phrase in [*NOTICES, *OPENINGS]:
        assert (NOTICES | OPENINGS)[phrase] in scan(f"x {phrase.upper()}, y")[0].split(","), phrase
        assert phrase == " ".join(phrase.lower().split()) and phrase.isascii()


def test_families():
    assert len(FREEDOM) == sum(len(ids.split()) for ids in FAMILIES.values())
    want = {"artistic-2.0": 0.7, "eupl-1.2": 0.5, "ofl-1.1": 0.7, "postgresql": 0.9, "mit-0": 1.0, "mit": 0.9, "gpl-3.0-or-later": 0.5, "cc-by-4.0": 0.9, "cc-by-nc-sa-4.0": 0.2, "cecill-c": 0.7, "cecill-2.1": 0.5, "some-other": 0.3}
    assert {i: freedom([i]) for i in want} == want
