"""Licence notices as files have them: wrapped, behind marks of comments, one after another."""

import random

import pytest

from sievelight.llm import licenses

BSD = """# Copyright (c) 2020, Someone
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
"""
ISC = """ * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
"""
LGPL = """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
"""


def test_wrapped_notices():
    model = licenses.train()
    of = lambda text: [(x[2], x[4]) for x in licenses.scan(text, model)]
    assert of(BSD) == [("proprietary", 0), ("BSD", 4), ("BSD", 5)]
    assert of(ISC) == [("ISC", 1)] and of(LGPL) == [("LGPL", 1)]
    a, n = licenses.scan(ISC, model)[0][:2]
    assert ISC[a:].startswith("Permission") and ISC[: a + n].endswith("granted")
    assert of("Licensed under the MIT license.\nLicensed under the Apache license version 2.0\nLicensed under the MIT license.") == [("MIT", 1), ("Apache-2.0", 0), ("MIT", 1)]
    assert of("Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted") == []


def test_every_wrapping_of_every_template():
    model = licenses.train()
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            for width in (3, 5, 9):
                w = t.split()
                text = "\n".join("  # " + " ".join(w[i : i + width]) for i in range(0, len(w), width))
                assert [x[2] for x in licenses.scan(text, model)] == [family], (t, width)


@pytest.fixture(scope="module")
def model():
    return licenses.train()


#: Notices as they stand in files, and their families; none is a wording that training or calibration has.
NOTICES = [
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD"), ("Published under the MIT licence", "MIT"), ("License: MIT", "MIT"), ("License: GPLv3", "GPL"), ("These data are available under CC BY 4.0.", "CC-BY"), ("CC0 1.0 Universal (see below)", "public-domain"),
    ("All content under Creative Commons Attribution 4.0.", "CC-BY"), ('  "license": "ISC",', "ISC"), ("license = 'Apache-2.0'", "Apache-2.0"), ("Dieses Werk: licensed under CC BY-SA 4.0", "CC-BY-SA"), ("Text available under CC BY 4.0", "CC-BY"),
    ("Unauthorized copying of this file is strictly prohibited", "proprietary"), ("(c) 2011 A. Nobody. All rights reserved.", "proprietary"), ("The engine is under the GNU Lesser General Public License, see COPYING.", "LGPL"), ("dual use under the AGPLv3 license", "AGPL"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed", "MPL-2.0"), ("I hereby say that it was released into the public domain in 1999", "public-domain"), ("photos licensed under CC BY-ND 4.0", "CC-BY-ND"), ("Licensed under CC BY-NC-SA 4.0!", "CC-BY-NC"),
]
#: Texts that speak of licences, rights and the like and grant nothing.
NONE = [
    "He got his driving licence at last.", "A licence to kill was released on video.", "The public domain of knowledge is wide.", "mit einer Lizenz fährt er", "Students of MIT are under the impression that all is well", "the BSD conference", "All rights come with duties.",
    "The seats are reserved for all members.", "He asked for permission to use the copy machine", "license: none", "The license of the bar was lost.", "cc: by mail, version 4.0", "Redistribution of land in the general public interest", "software engineers wanted",
]


@pytest.mark.parametrize("text, family", NOTICES)
def test_notices(model, text, family):
    assert [x[2] for x in licenses.scan(text, model)] == [family]
    assert [x[2] for x in licenses.scan(f"One two three.\n\n{text}\n\nFour five.", model)] == [family]


@pytest.mark.parametrize("text", NONE)
def test_no_notices(model, text):
    assert licenses.scan(text, model) == []


def test_held_out_wordings(model):
    """What calibration saw but training didn't: the classifier knows nearly all, and the scan finds nothing in the others."""
    rows = [(t, f) for f, ts in licenses.HELD.items() for t in ts]
    assert sum(model.predict(t)[0] == f for t, f in rows) >= 0.95 * len(rows)
    assert sum(model.predict(t)[0] != licenses.UNKNOWN for t in licenses.HELD_OTHERS) <= 0.2 * len(licenses.HELD_OTHERS)
    assert [t for t in (*licenses.HELD_OTHERS, *licenses.OTHERS) if licenses.scan(t, model)] == []


def test_whole_mit_text(model):
    """Title, grant and notice of a wrapped licence text."""
    text = "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    found = licenses.scan(text, model)
    assert [x[2] for x in found] == ["MIT"] * 3 and text[found[1][0] :].startswith("Permission") and text[: found[2][0] + found[2][1]].endswith("the Software")


def test_nothing_decides_before_the_classifier(model):
    """Notices of a line far into a long paragraph, and among many others' words, are found wherever they stand."""
    rng = random.Random(3)
    for text, family in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Released under the MIT License.", "MIT"), ("License: GPLv3", "GPL")):
        for at in (0, 1, 17, 24, 25, 47, 200):
            words = [rng.choice(licenses.FILLER + licenses.FUNCTION_WORDS + ["größe", "12", "été"]) for _ in range(260)]
            whole = " ".join(words[:at]) + "\n" + text + "\n" + " ".join(words[at:])
            found = licenses.scan(whole, model)
            assert [x[2] for x in found] == [family], (text, at)
            assert text.startswith(whole[found[0][0] : found[0][0] + found[0][1]][:8])


def test_cover_equals_counting():
    """A template is covered if and only if enough of its triples are there, counted one by one."""
    rng, s = random.Random(1), licenses.Settings()
    for k, (family, i, own) in enumerate(licenses._TEMPLATES):
        for _ in range(6):
            words = licenses.words_of(licenses.TEMPLATES[family][i])
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "zzz"
            n = min(3, len(words))
            count = len({tuple(words[j : j + n]) for j in range(len(words) - n + 1)} & own)
            places = [x for x in licenses.covered(words, s, {family}) if x[2] == k]
            assert bool(places) == (count >= licenses.needed(own, s.cover)) and all(x[3] == count for x in places)


def test_words_equal_plain_python():
    import re

    text = "The 'License': MIT-v2.0 é x.5 a.b 1.2.3 licence = y\nLICENCES of.. 日本 z"
    want = [licenses.SPELLED.get(w.lower(), w.lower()) for w in re.findall(r"[A-Za-z0-9]+(?:\.[0-9][A-Za-z0-9]*)*", text)]
    assert [w.rstrip(":") for w in licenses.words_of(text)] == want and [w for w in licenses.words_of(text) if w.endswith(":")] == ["license:", "license:"]


def test_query_equals_one_text_at_a_time(spark, model):
    """The operator over many texts at once, with odd rows among them, gives what each text gives alone."""
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(None, NOTICES[0][0]), (0, NOTICES[0][0]), (98, None), (99, ""), (100, "x " * 200_000 + "\n\nLicense: MIT\n\n" + "y " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(repr((d, *x)) for d, t in rows for x in licenses.scan(t or "", model))
    assert sorted(repr(tuple(r)) for r in licenses.licences(df, model).collect()) == want and len(want) == len(NOTICES) + 3
