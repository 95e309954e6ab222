"""The keyword prefilter of the license rules."""

import re
import re._constants as sre
import re._parser as sre_parse

import pytest

from quarry.llm import license_scan


def texts_of(parsed):
    """Every text that a parsed word pattern hits."""
    found = [""]
    for kind, value in parsed:
        if kind == sre.LITERAL:
            each = [chr(value)]
        elif kind == sre.IN:
            each = [chr(v) for _, v in value]
        elif kind == sre.BRANCH:
            each = [x for branch in value[1] for x in texts_of(branch)]
        elif kind == sre.SUBPATTERN:
            each = texts_of(value[3])
        else:
            assert kind == sre.MAX_REPEAT and value[:2] == (0, 1)
            each = ["", *texts_of(value[2])]
        found = [f + x for f in found for x in each]
    return found


def test_license_prefilter_loses_no_rule():
    for label, key, pattern, _, _, needs in license_scan.RULES:
        for text in texts_of(sre_parse.parse(pattern)):
            assert key in text.split(), (label, key, text)
            assert all(n in f" {text} " for n in needs), (label, needs, text)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the Expat License", ["mit"]),
        ("the Expat licence", ["mit"]),
        ("PSF license", ["python"]),
        ("available under the PSF license", ["python"]),
        ("the FreeBSD license", ["bsd-2"]),
        ("SPDX-License-Identifier: FreeBSD license", ["bsd-2"]),
    ],
)
def test_license_names_without_the_family_keyword(spark, text, labels):
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections
    assert [d.label for d in found] == labels


def sample_texts():
    """A text from each rule, and texts of several rules."""
    texts = [texts_of(sre_parse.parse(pattern))[-1] for _, _, pattern, *_ in license_scan.RULES]
    mixed = [" and then ".join(texts[i :: 97][:5]) for i in range(0, 97, 3)]
    return texts[: len(license_scan.SIGNATURES)] + texts[len(license_scan.SIGNATURES) :: 30] + mixed[::3]


def plain_scan(text):
    """Surviving finds (label, start, stop, priority, confidence) of every rule, tried without a gate and judged pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    spaced = "".join(f" {w} " for w in words)
    finds = []
    for rule, (label, _, pattern, priority, confidence, _) in enumerate(license_scan.RULES):
        for m in re.finditer(license_scan._spaced(pattern), spaced):
            start = len(spaced[: m.start()].split())
            finds.append((start, start + len(m[0].split()), label, priority, confidence, rule))

    def beaten(x):
        for y in finds:
            if y[0] <= x[0] and y[1] >= x[1]:
                if y[3] > x[3] or (y[3] == x[3] and (y[1] - y[0] > x[1] - x[0] or (y[:2] == x[:2] and y[5] < x[5]))):
                    return True
        return False

    return sorted({x[:5] for x in finds if not beaten(x)})


def test_license_detections_equal_a_scan_without_gate(spark):
    texts = sample_texts() + ["", "no license here", "MIT license mit license MIT License, cc by nc; CC-BY-NC-SA 4.0 cc by", "gpl gpl 2 or later gnu gpl version 2 or later"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = sorted((d.start, d.stop, d.label, d.priority, d.confidence) for d in r.detections)
        assert got == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_a_body_outranks_the_names_inside_it(spark):
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    rows = license_scan.scan(spark.createDataFrame([(1, body), (2, apache), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(d.label, d.start) for d in r.detections] for r in rows] == [[("mit", 0)], [("apache-2", 0)], []]


ISC = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


@pytest.mark.parametrize(
    "text, labels",
    [
        (ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES', {"isc"}),
        (ISC + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', {"curl"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2+"}),
        ("GPLv3", {"gpl-3"}),
        ("GPLv2 or later", {"gpl-2+"}),
        ("LGPLv2.1", {"lgpl-2.1"}),
        ("the Apache helicopter", set()),
    ],
)
def test_wordings_that_differ_in_little(spark, text, labels):
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections
    assert {d.label for d in found} == labels


def test_many_finds_in_one_text_and_an_empty_table(spark):
    many = spark.createDataFrame([(1, "gnu gpl version 2 and " * 4000)], "doc_id long, text string")
    found = license_scan.scan(many).first()
    assert found.n_words == 20_000 and len(found.detections) == 4000 and {d.label for d in found.detections} == {"gpl-2"}
    assert license_scan.scan(many.limit(0)).count() == 0
