"""License scans: the gate before the rules, on generated matches."""

import random
import re

import pyarrow as pa

from foliograph.llm import licenses, textops


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def one_of(kind, x, rng):
    match str(kind):
        case "LITERAL":
            return chr(x)
        case "RANGE":
            return chr(rng.randint(*x))
        case "CATEGORY" if "NOT_SPACE" in str(x):
            return rng.choice("xyz")
        case "CATEGORY" if "NOT_WORD" in str(x):
            return rng.choice('"*')
        case "CATEGORY":
            return rng.choice([" ", "\n", "\t", "\r\n", "  "])
        case _:
            return "~"


def matching(parsed, rng):
    """A random string that a parsed pattern matches, but for what it looks around for."""
    out = ""
    for op, x in parsed:
        match str(op):
            case "IN":
                out += one_of(*(x[0] if str(x[0][0]) == "NEGATE" else rng.choice(x)), rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(matching(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
            case "BRANCH":
                out += matching(rng.choice(x[1]), rng)
            case "SUBPATTERN":
                out += matching(x[3], rng)
            case "ASSERT" | "ASSERT_NOT":
                pass
            case _:
                out += one_of(op, x, rng)
    return out


def scan(own):
    return licenses.Scanner().scan(textops.texts(pa.array(own)))


def test_gate_loses_no_match():
    rng, every = random.Random(4), licenses.rules()
    own, seen = [], set()
    for r in every:
        for _ in range(6):
            text = matching(re._parser.parse(r.pattern.pattern), rng)
            seen |= {r} if r.pattern.search(text) else set()
            own.append(f"See {text.upper()}.")
    assert seen == set(every)
    got = scan(own)
    for text, labels, found in zip(own, got["labels"].to_pylist(), got["detections"].to_pylist(), strict=True):
        want = licenses.detect(lower(text), every)
        assert [(x["label"], x["start"], x["end"], x["relevance"]) for x in found] == [(x.label, x.start, x.end, x.relevance) for x in want], text
        assert {x.label for x in want} <= set(labels.split(",")), text


def test_keyword_inside_a_word():
    got = scan(["This software is licensed under GPLv2.", "LGPLv2.1", "AGPLv3", "gpl2", "under the FreeBSD license", "CDDL1.0", "CC01.0", "Copyright2020", "no gplish words"])
    assert got["labels"].to_pylist() == ["gpl-2", "lgpl-2", "agpl-3", "gpl-2", "bsd-2", "cddl", "cc0", "copyright", ""]
    assert got["score"].to_pylist()[0] == 1.0


def test_wrapped_notices():
    got = scan([
        "This library comes under the GNU Lesser General Public\nLicense, version\n  2.1",
        "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
        'you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/\n',
        "Copyright (c) 2020, Some One\nAll rights reserved.",
        "under CC BY\n  NC 4.0",
        "Mozilla\tPublic  License\r\nVersion 2.0",
        "Lesser  General\nPublic License",
        "the  General\nPublic License",
    ])
    assert got["labels"].to_pylist() == ["gpl,lgpl-2", "gpl", "apache-2.0", "reserved", "cc-by,cc-by-nc", "mpl-2.0", "gpl", "gpl"]
    found = [[x["label"] for x in one] for one in got["detections"].to_pylist()]
    assert found == [["lgpl-2"], ["gpl"], ["apache-2.0"], ["reserved"], ["cc-by-nc"], ["mpl-2.0"], [], ["gpl"]]


def test_spdx_identifiers():
    own = ["MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0", "MIT-0", "(MIT OR Apache-2.0) AND BSD-2-Clause", "GPL-2.0-only WITH Classpath-exception-2.0", "MITNFA"]
    got = scan([f"// SPDX-License-Identifier: {x}\nint x;" for x in own])
    assert got["labels"].to_pylist() == ["mit", "apache-2.0", "bsd-3", "mpl-2.0", "mit-0", "apache-2.0,bsd-2,mit", "gpl-2", ""]


def plain(found):
    taken = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(t.start <= d.start and d.end <= t.end for t in taken):
            taken.append(d)
    return sorted(taken, key=lambda d: (d.start, d.end))


def test_containment_against_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        found = [licenses.Detection(rng.choice("abc"), a, a + rng.randint(1, 12), rng.choice([10, 20, 20, 30]), 0.5) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        assert licenses.resolve(found) == plain(found)


def test_many_mentions_in_one_text():
    got = scan(["the mit license, " * 60_000])
    assert got["labels"].to_pylist() == ["mit"] and len(got["detections"][0]) == 60_000


def test_labels_and_score_without_gate():
    """labels and score of whole texts, from all rules and the base phrases, with no gate."""
    own = [None, "", "Use, modify.", "General public license. ALL rights reserved!", "cc by", "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person obtaining a copy", "This is free and unencumbered software released into the public domain."]
    got = scan(own)
    for text, labels, score in zip(own, got["labels"].to_pylist(), got["score"].to_pylist(), strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        base = {label for phrase, label in licenses.BASE.items() if any(words[k : k + len(phrase.split())] == phrase.split() for k in range(len(words)))}
        found = licenses.detect(lower(text or ""), licenses.rules())
        assert labels == ",".join(sorted(base | {x.label for x in found}))
        assert score == max([0.5 * bool(base), *(x.relevance for x in found)])
