"""Licence scans: a trained classifier of paragraphs names licence families, and a comparison with their templates confirms them.

1. A paragraph is a run of lines that hold a word, whatever marks of comments stand before it. Every paragraph of every text is
   classified, in windows of two times `Settings.half` words that overlap by half; no word or pattern decides beforehand.
2. The classifier is a logistic regression over sparse hashed n-grams of one to three words, one for each family, trained on the
   driver by stochastic gradient descent on paragraphs made by rule from wordings of licences, alone, cut, and set among other
   words, and on texts that share words with them. Each family's score is calibrated (scale and shift) on wordings that training
   doesn't see; a window that no family's score reaches `Settings.least` in is of the unknown class. A text's n-grams are looked up by their whole
   hash, so words that training doesn't know weigh nothing.
3. What is classified is compared with the templates of the families found there: a template confirms where the share of its word
   triples in one place is at least `Settings.cover`, for one of at most eight words all of them but one, for one of at most four
   words all. Line ends and words in between don't matter. Of places that overlap, the best covered one stays.

Defined cases: null and empty texts have no findings; whole texts are read; equal rows give equal rows; a null id stays null; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows, text_sizes, texts_of
from .neardup import mix, powers

#: Wordings of public licences and notices, in lower case without punctuation.
WORDINGS: dict[str, tuple[str, ...]] = {
    "MIT": (
        "released under the mit license",
        "licensed under the mit license",
        "distributed under the terms of the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "Apache-2.0": (
        "licensed under the apache license version 2.0",
        "released under the apache license 2.0",
        "spdx license identifier apache 2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "GPL": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "licensed under the gpl version 3",
        "released under the gnu gpl v3",
        "spdx license identifier gpl 3.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "LGPL": (
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx license identifier lgpl 2.1 or later",
    ),
    "AGPL": (
        "licensed under the gnu affero general public license version 3",
        "spdx license identifier agpl 3.0 or later",
        "under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    "BSD": (
        "licensed under the bsd license",
        "released under the bsd 3 clause license",
        "use of this source code is governed by a bsd style license",
        "spdx license identifier bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "ISC": (
        "licensed under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "MPL-2.0": (
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "spdx license identifier mpl 2.0",
    ),
    "CC-BY": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "CC-BY-SA": (
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ),
    "CC-BY-NC": (
        "licensed under cc by nc 4.0",
        "licensed under cc by nc sa 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ),
    "CC-BY-ND": (
        "licensed under cc by nd 4.0",
        "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    ),
    "public-domain": (
        "released into the public domain",
        "this is free and unencumbered software released into the public domain",
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "licensed under cc0 1.0 universal",
    ),
    "proprietary": (
        "all rights reserved",
        "no part of this publication may be reproduced without the prior written permission of the publisher",
        "confidential and proprietary unauthorized copying of this file is strictly prohibited",
    ),
}
#: Short names of licences. `short_forms` makes notices of them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit", "expat"),
    "Apache-2.0": ("apache 2.0", "apache 2", "apache license 2.0", "apache license version 2.0", "apache software license"),
    "GPL": ("gpl", "gplv2", "gplv3", "gpl v2", "gpl v3", "gpl 2.0", "gpl 3.0", "gpl version 2", "gpl version 3", "gnu gpl", "gnu gplv3", "gnu gpl v3", "gnu general public license"),
    "LGPL": ("lgpl", "lgplv2.1", "lgplv3", "lgpl 2.1", "lgpl 3.0", "lgpl v3", "gnu lgpl", "gnu lesser general public license"),
    "AGPL": ("agpl", "agplv3", "agpl 3.0", "agpl v3", "gnu agpl", "gnu agplv3", "gnu affero general public license"),
    "BSD": ("bsd", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "simplified bsd", "new bsd"),
    "ISC": ("isc",),
    "MPL-2.0": ("mpl", "mpl 2.0", "mplv2.0", "mozilla public license 2.0", "mozilla public license version 2.0"),
    "CC-BY": ("cc by 4.0", "cc by 3.0", "creative commons attribution 4.0", "creative commons attribution 3.0"),
    "CC-BY-SA": ("cc by sa 4.0", "cc by sa 3.0", "creative commons attribution sharealike 4.0", "creative commons attribution share alike 4.0"),
    "CC-BY-NC": ("cc by nc 4.0", "cc by nc sa 4.0", "cc by nc nd 4.0", "creative commons attribution noncommercial 4.0", "creative commons attribution non commercial 4.0"),
    "CC-BY-ND": ("cc by nd 4.0", "creative commons attribution noderivatives 4.0"),
    "public-domain": ("cc0", "cc0 1.0", "cc0 1.0 universal", "unlicense"),
}
#: Wordings that only calibration sees.
HELD: dict[str, tuple[str, ...]] = {
    "MIT": ("This project is provided under the terms of the MIT licence, see the file for details.", "The code in this folder is open source (MIT License).", "license = \"MIT\"", "Permission is granted free of charge to any person who obtains a copy of this software and associated documentation files"),
    "Apache-2.0": ("The source is made available under the Apache License, Version 2.0; see NOTICE.", "License: Apache-2.0", "You may not use these files except in compliance with the License, which is the Apache License 2.0"),
    "GPL": ("It comes under the GNU General Public License, version 3 or any later one.", "License: GPLv3", "SPDX-License-Identifier: GPL-2.0-only", "you can redistribute it under the terms of the GNU General Public License"),
    "LGPL": ("The library may be used under the GNU Lesser General Public License, version 3.", "License: LGPLv3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL": ("The server is under the GNU Affero General Public License, version 3.", "License: AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("This is free software under the 3-clause BSD license.", "License: BSD", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution in source and binary forms, with or without modification, is permitted provided that these conditions are met"),
    "ISC": ("Distributed under the ISC license.", "License: ISC", "Permission to use, copy, modify, and distribute this software with or without fee is granted"),
    "MPL-2.0": ("The files are under the Mozilla Public License, version 2.0.", "License: MPL-2.0", "This Source Code is subject to the terms of the Mozilla Public License"),
    "CC-BY": ("Content under Creative Commons Attribution 4.0.", "This data set is available under CC BY 4.0.", "License: CC-BY-4.0"),
    "CC-BY-SA": ("Text under Creative Commons Attribution-ShareAlike 4.0.", "The corpus is available under CC BY-SA 4.0.", "License: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Pictures under Creative Commons Attribution-NonCommercial 4.0.", "The corpus is available under CC BY-NC 4.0.", "License: CC-BY-NC-4.0"),
    "CC-BY-ND": ("Music under Creative Commons Attribution-NoDerivatives 4.0.", "The recording is available under CC BY-ND 4.0.", "License: CC-BY-ND-4.0"),
    "public-domain": ("The author released this into the public domain.", "CC0 1.0 Universal", "License: CC0-1.0"),
    "proprietary": ("Copyright 2019 Example Inc. All rights reserved.", "Confidential. Unauthorized copying of these pages is strictly prohibited.", "No part of this book may be reproduced without written permission of the publisher."),
}
HELD_OTHERS = (
    "the students license their photos to the paper", "a permission slip for the trip is due on friday", "his rights were read to him by the officer", "mit einer Lizenz der Stadt darf er fahren", "the general had no public opinion on it",
    "the bsd daemon is a well known drawing", "version 2.0 of the report was reserved for members", "the creative team gave commons rooms to all", "an isc meeting was held in the library", "software under test must not be changed",
    "she is a licensed driver under the age of thirty", "the domain of the function is the public set", "copyright was the topic of the lecture", "the apache tribe lived on the plains", "license: to be decided later by the board",
)
#: Sentences that share words with licences but grant nothing, and words to set around.
OTHERS = (
    "he lost his driver license on the way to the office", "the license plate was covered with mud", "they applied for a fishing license in spring", "all rights and duties of the tenant",
    "the hotel reserved a room for all guests", "permission to land was given by the tower", "she asked for permission to leave early", "human rights are rights that all people have",
    "the public domain of the city park was cleaned", "the software version was changed to 2.0", "a general public meeting was held", "the apache helicopter landed", "students of mit won the prize",
    "version 3 of the document is ready", "the creative work of the common people", "under the terms of the contract", "copyright law was debated in parliament", "the license fee was raised",
    "the driver had no licence", "redistribution of wealth was promised", "the proprietary medicine was sold out", "a bar without a liquor license", "the commons were used by all farmers",
)
FILLER = "the of and to in that was for with as on at by from they were had his her which one all would there their what about out up time some could other than then only new its over also back after use two how our work first well even want because any these give day most".split()


FUNCTION_WORDS = "this a an is it you he she we they not no may be are or any can do if so see".split()
UNKNOWN = "unknown"
_Q = np.uint64(0xD1342543DE82EF95)
_CLASS = np.array([1 if chr(i).isalnum() else 0 for i in range(128)] + [0] * 128, bool)
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: One spelling, and the words after which a sign of assignment belongs to the word.
SPELLED = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense"}
ASSIGNED = ("license", "licence", "licenses", "licences", "identifier")


def short_forms(family: str) -> list[str]:
    """Notices that consist of a name: fields of package files, SPDX lines, `under ...`."""
    out = []
    for n in NAMES.get(family, ()):
        out += [f"license: {n}", f"identifier: {n}", f"under the {n} license", f"licensed under {n}"]
        out += [f"{n} license"] if "license" not in n else [f"under the {n}"]
        out += [f"under {n}", f"under the {n}"] if any(c.isdigit() for c in n) and " " in n else []
    return out + (["cc0 1.0 universal"] if family == "public-domain" else [])


#: All templates of each family: wordings first, then the short forms.
TEMPLATES = {f: (*w, *short_forms(f)) for f, w in WORDINGS.items()}


@dataclass(frozen=True)
class Settings:
    half: int = 24  # a window has two halves
    made: int = 260  # paragraphs for each family
    epochs: int = 8
    rate: float = 0.3
    seed: int = 4
    least: float = 0.5
    cover: float = 0.6
    window: int = 60  # words that a template's place may span


# Words and n-grams ------------------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """The words of several texts: where they lie in the joined bytes, their hashes, and the paragraph and text of each."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    paragraph: np.ndarray
    firsts: np.ndarray  # where each text begins in the bytes

    def text(self, i: int) -> str:
        w = self.data[self.start[i] : self.end[i]].decode()
        return SPELLED.get(w, w) + (":" if w in ASSIGNED and _assigned(self.data, int(self.end[i])) else "")


def _assigned(data: bytes, at: int) -> bool:
    """Whether a colon or an equals sign follows, after a closing quote and blanks."""
    rest = data[at : at + 8].lstrip(b"\"' \t")
    return rest[:1] in (b":", b"=") and b"\n" not in data[at : at + 8 - len(rest)]


def _hash_of(words: list[str]) -> np.ndarray:
    return read([" ".join(words)], plain=True).hashes


def read(texts: list[str], plain: bool = False) -> Words:
    """Words are runs of ASCII letters and digits, with a dot before a digit, in lower case; a paragraph ends where two line feeds stand between words."""
    raw = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
    data = b"\n\n" + b"\n\n".join(raw) + b"\n\n"
    b = np.frombuffer(data, np.uint8)
    inner = _CLASS[b]
    inner[1:-1] |= (b[1:-1] == 46) & inner[:-2] & _DIGIT[b[2:]]
    start = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    end = np.flatnonzero(~inner[1:] & inner[:-1]) + 1
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)])])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _Q)
    if not plain:
        for i in np.flatnonzero(np.isin(h, _ASSIGNED_HASHES)):
            if _assigned(data, int(end[i])):
                h[i] = _COLON[int(h[i])]
        for i in np.flatnonzero(np.isin(h, _SPELLED_HASHES)):
            h[i] = _SPELL[int(h[i])]
    lines = np.concatenate([[0], np.cumsum(b == 10)])
    new = lines[start[1:]] - lines[end[:-1]] >= 2 if len(start) else np.zeros(0, bool)
    firsts = np.cumsum([2] + [len(x) + 2 for x in raw])[:-1]
    return Words(data, start, end, h, np.concatenate([[0], np.cumsum(new)])[: len(start)], firsts)


_SPELL = {int(_hash_of([a])[0]): _hash_of([b])[0] for a, b in SPELLED.items()}
_COLON = {int(_hash_of([w])[0]): mix(_hash_of([SPELLED.get(w, w)]) ^ np.uint64(58))[0] for w in ASSIGNED}
_SPELLED_HASHES, _ASSIGNED_HASHES = (np.array(list(x), np.uint64) for x in (_SPELL, _COLON))


def ngrams(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of one to three words that begin at each word, and whether they lie within its paragraph."""
    h, p = w.hashes, w.paragraph
    out = [(h, np.ones(len(h), bool))]
    run = h
    for n in (1, 2):
        run = mix(run[: len(h) - n] * _Q + h[n:]) if len(h) > n else np.zeros(0, np.uint64)
        whole, ok = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        whole[: len(run)], ok[: len(run)] = run, p[n:] == p[: len(run)]
        out.append((whole, ok))
    return out


# The classifier -----------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    families: list[str]
    known: np.ndarray  # sorted hashes of the n-grams that training met
    weights: np.ndarray  # n-grams x families, and a last row of zeros for those it didn't
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    s: Settings
    bits: int = 20

    def __post_init__(self) -> None:
        # A table by leading bits spares the search; of known n-grams that share a place the search finds the others.
        self.slot = np.full(1 << self.bits, len(self.known), np.int32)
        at = (self.known >> np.uint64(64 - self.bits)).astype(np.int64)
        self.slot[at] = np.arange(len(self.known))
        self.shared = np.bincount(at, minlength=1 << self.bits) > 1

    def rows(self, h: np.ndarray, ok: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.slot[at]
        last = len(self.known)
        again = np.flatnonzero(self.shared[at])
        row[again] = np.minimum(np.searchsorted(self.known, h[again]), last - 1)
        return np.where(ok & (row < last) & (self.known[np.minimum(row, last - 1)] == h), row, last)

    def summed(self, w: Words, starts: np.ndarray) -> np.ndarray:
        """The sums of the weights of the n-grams that begin in each group of words; `starts` are the groups' first words."""
        out = np.zeros((len(starts), len(self.families)))
        rows = [self.rows(h, ok) for h, ok in ngrams(w)]
        hit = np.flatnonzero(np.any([r < len(self.known) for r in rows], axis=0))  # most words weigh nothing
        group = np.searchsorted(starts, hit, "right") - 1
        for a in range(0, len(hit), 1 << 16):
            part = hit[a : a + (1 << 16)]
            np.add.at(out, group[a : a + (1 << 16)], sum(self.weights[r[part]] for r in rows))
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((sums + self.bias) * self.scale + self.shift, -60, 60)))

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest family of a short text and its score; the unknown class with what is left where none reaches the least score."""
        w = read([text])
        p = self.scores(self.summed(w, np.zeros(1, np.int64)))[0] if len(w.start) else np.zeros(len(self.families))
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= self.s.least else (UNKNOWN, float(1 - p[k]))


def _surrounded(texts: dict[str, tuple[str, ...]], others: tuple[str, ...], made: int, s: Settings, seed: int) -> list[tuple[str, set[str]]]:
    """Paragraphs made by rule, at most a window long, and their families."""
    rng = random.Random(seed)
    word = lambda: rng.choice(FILLER) if rng.random() < 0.6 else "".join(rng.choices("abdeghiklmnoprstu", k=rng.randint(2, 9)))
    around = lambda n: " ".join(word() for _ in range(rng.choice([0, 0, rng.randint(0, n)])))
    out: list[tuple[str, set[str]]] = []
    for family, own in texts.items():
        for i in range(made):
            w = own[i % len(own)].split()
            if len(w) > 12 and rng.random() < 0.5:
                a = rng.randint(0, len(w) // 3)
                w = w[a : max(a + 8, len(w) - rng.randint(0, len(w) // 3))]
            more = set()
            for _ in range(rng.choice([0, 0, 1, 2]) if len(w) < 14 else 0):  # several licences in one place
                other = rng.choice(list(texts))
                if short := [t for t in texts[other] if len(t.split()) < 12]:
                    w = [*w, *([word()] * rng.randint(0, 1)), *rng.choice(short).split()]
                    more.add(other)
            out.append((f"{around(16)} {' '.join(w)} {around(16)}", {family} | more))
    for i in range(made * 8):
        w = rng.choice(others).split() if i % 2 else []
        if i % 5 == 0:  # words of licences out of order
            w = w + rng.sample((rng.choice(rng.choice(list(texts.values()))) + " of and").split(), 3)
        if i % 7 == 0:
            w = [rng.choice(["license:", "license", "licensed under", "under the"]), word(), word(), *w]
        if i % 7 == 3:  # a name of a licence without a notice
            w = [*w, word(), rng.choice(rng.choice(list(NAMES.values()))), word()]
        out.append((f"{around(20)} {' '.join(w)} {around(20)}", set()))
    rng.shuffle(out)
    return out


def train(s: Settings = Settings()) -> Model:
    families = list(TEMPLATES)
    data = _surrounded(TEMPLATES, OTHERS, s.made, s, s.seed)
    grams = []
    for text, _ in data:
        parts = [h[ok] for h, ok in ngrams(read([text]))]
        grams.append(np.unique(np.concatenate(parts)))
    known, met = np.unique(np.concatenate(grams), return_counts=True)
    plain = np.concatenate([h[ok] for h, ok in ngrams(read([" ".join(p) for p in itertools.product([*FILLER, *FUNCTION_WORDS], repeat=2)]))])
    known = known[(met > 1) & ~np.isin(known, plain)]  # what stands in one paragraph alone is chance, and words that stand everywhere say nothing
    x = [np.searchsorted(known, g[np.isin(g, known)]) for g in grams]
    y = np.array([[f in own for f in families] for _, own in data], float)
    weights, bias = np.zeros((len(known) + 1, len(families))), np.full(len(families), -2.0)
    rng = np.random.default_rng(s.seed)
    for epoch in range(s.epochs):
        rate = s.rate / (1 + epoch / 2)
        for i in rng.permutation(len(x)):
            if len(x[i]):
                g = 1 / (1 + np.exp(-(weights[x[i]].sum(0) + bias))) - y[i]
                weights[x[i]] -= rate * (g / np.sqrt(len(x[i])) + 1e-3 * weights[x[i]])
                bias -= 0.05 * rate * g
    ones = np.ones(len(families))
    model = Model(families, known, weights.astype(np.float32), bias, ones, 0 * ones, s)
    held = _surrounded(HELD, HELD_OTHERS, 60, s, s.seed + 1)
    z = np.concatenate([model.summed(read([t]), np.zeros(1, np.int64)) for t, _ in held]) + bias
    y = np.array([[f in own for f in families] for _, own in held], float)
    for k in range(len(families)):
        best = min(((a, b) for a in np.geomspace(0.3, 3, 11) for b in np.linspace(-3, 3, 25)), key=lambda ab: _loss(z[:, k] * ab[0] + ab[1], y[:, k]))
        model.scale[k], model.shift[k] = best
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean())


# Templates ------------------------------------------------------------------------------------------------------------------------


def words_of(text: str) -> list[str]:
    w = read([text])
    return [w.text(i) for i in range(len(w.start))]


def triples(words: list[str]) -> set[tuple[str, ...]]:
    """The runs of three words; a template of two words is one run of two."""
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


#: Triples of each template by family and number in the family; the templates of each triple.
_TEMPLATES = [(f, i, triples(words_of(t))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
_HOLDERS: dict[tuple[str, ...], list[int]] = {}
for _k, (_, _, _own) in enumerate(_TEMPLATES):
    for _t in _own:
        _HOLDERS.setdefault(_t, []).append(_k)


def needed(own: set[tuple[str, ...]], cover: float) -> int:
    """How many of a template's triples confirm it."""
    n = len(own)
    return n if n <= 2 else n - 1 if n <= 6 else math.ceil(cover * n - 1e-9)


def covered(words: list[str], s: Settings, families: set[str] | None = None) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, template, covered triples) of each place where a template, of these families, is covered enough.

    Triples of a template belong to one place as long as none repeats, they are at most half a window apart, and fit a window.
    """
    open_: dict[int, list] = {}
    found = []

    def close(k: int) -> None:
        first, last, seen = open_.pop(k)
        if len(seen) >= needed(_TEMPLATES[k][2], s.cover):
            found.append((first, last, k, len(seen)))

    for at in range(len(words)):
        for n in (2, 3):
            t = tuple(words[at : at + n])
            for k in _HOLDERS.get(t, ()) if len(t) == n else ():
                if families is not None and _TEMPLATES[k][0] not in families:
                    continue
                if k in open_ and (t in open_[k][2] or at + n - open_[k][1] > s.window // 2 or at + n - open_[k][0] > s.window):
                    close(k)
                if k in open_:
                    open_[k][1] = at + n
                    open_[k][2].add(t)
                else:
                    open_[k] = [at, at + n, {t}]
    for k in list(open_):
        close(k)
    return found


def _best(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of places that overlap the one with the greatest product of covered triples and share, then the longest."""
    kept: list[tuple[int, int, int, int]] = []
    for a, b, k, n in sorted(set(places), key=lambda x: (-x[3] * x[3] / len(_TEMPLATES[x[2]][2]), x[0] - x[1], x[0], x[2])):
        if all(b <= y[0] or a >= y[1] for y in kept):
            kept.append((a, b, k, n))
    return sorted(kept)


def scan_all(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float, int, float]]]:
    """For each text (start, length, family, score, template, cover) of each place under a licence, from the template's first word in it to its last."""
    out: list[list] = [[] for _ in texts]
    w, s = read(texts), model.s
    if not len(w.start):
        return out
    # Halves of windows: runs of words of one paragraph.
    first = np.flatnonzero(np.concatenate([[True], w.paragraph[1:] != w.paragraph[:-1]]))
    place = np.arange(len(w.start)) - first[w.paragraph]
    halves = np.flatnonzero(place % s.half == 0)
    ends = np.append(halves[1:], len(w.start))
    para = w.paragraph[halves]
    sums = model.summed(w, halves)
    whole = sums.copy()
    joined = np.flatnonzero(para[1:] == para[:-1])
    whole[joined] += sums[joined + 1]
    p = model.scores(whole)
    near: dict[int, dict[int, set[str]]] = {}
    for i, k in zip(*np.nonzero(p >= s.least), strict=True):
        for j in range(i - 2, i + 4):
            if 0 <= j < len(halves) and para[j] == para[i]:
                near.setdefault(int(para[i]), {}).setdefault(j, set()).add(model.families[k])
    text_of = np.searchsorted(w.firsts, w.start[halves], "right") - 1
    for _, some in sorted(near.items()):
        places: list[tuple[int, int, int, int]] = []
        order = sorted(some)
        runs = np.split(order, np.flatnonzero(np.diff(order) > 1) + 1)
        for run in runs:
            a, b = int(halves[run[0]]), int(ends[run[-1]])
            words = [w.text(i) for i in range(a, b)]
            said = set().union(*(some[int(j)] for j in run))
            places += [(a + i, a + j, k, n) for i, j, k, n in covered(words, s, said)]
        doc = int(text_of[order[0]])
        for a, b, k, n in _best(places):
            family, template, own = _TEMPLATES[k]
            i, j = int(w.start[a]), int(w.end[b - 1])
            own_words = Words(w.data, w.start[a:b], w.end[a:b], w.hashes[a:b], w.paragraph[a:b], w.firsts)
            score = model.scores(model.summed(own_words, np.zeros(1, np.int64)))[0][model.families.index(family)]
            head = len(w.data[w.firsts[doc] : i].decode())
            out[doc].append((head, len(w.data[i:j].decode()), family, round(float(score), 6), template, round(n / len(own), 6)))
    return [sorted(x) for x in out]


def scan(text: str, model: Model) -> list[tuple[int, int, str, float, int, float]]:
    return scan_all([text], model)[0]


ROWS = "doc_id long, start long, length long, family string, score double, template long, cover double"


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*[x.split() for x in ROWS.split(", ")], strict=True)
    for b in by_rows(batches, text_sizes(), 2 << 20):
        rows = [(d, *r) for d, found in zip(b.column("doc_id").to_pylist(), scan_all(texts_of(b), model), strict=True) for r in found]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each licence notice: doc_id, its place (code points from 0), family, score, template, cover."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    return docs.select("doc_id", "text").mapInArrow(lambda it: _found(it, shared.value), ROWS)
