"""Whole licence texts, phrasings that the templates have not, the scorer against brute force, and names that clash."""

import re

import numpy as np

from quillspark.llm import licenses
from tests.llm.test_licenses import results

MIT = """MIT License

Copyright (c) 2019 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
"""
#: Phrasings of notices that are in no template.
UNSEEN = {
    "The code in this repository is available under the MIT license.": "mit",
    "This library is distributed under the Apache License 2.0, see LICENSE": "apache",
    "Unless otherwise noted, all content here is licensed under a Creative Commons Attribution 4.0 International license": "cc-by",
    "gizmo is free software released under the GNU General Public License v3": "gpl",
    "Our photos are shared under CC BY-NC 4.0": "cc-by-nc",
    "(c) 2021 Example Press. All rights reserved worldwide.": "proprietary",
    "The package is dual hosted and licensed under the Mozilla Public License 2.0": "mpl",
    "You can use this under the terms of the GNU Lesser General Public License version 3": "lgpl",
}
ORDINARY = ["the licence plate of the car was stolen last week", "he read about the public domain of the king", "this text is about the history of software in the public service", "the general terms of the contract were not met", "we are free to use the work of others with a notice"]


def paragraphs(text):
    """(run, n, block, text) by plain Python."""
    lines, out, run = (text or "").replace("\x00", " ").split("\n"), [], []
    for n, line in enumerate([*lines, None]):
        if line is not None and re.search(licenses.evidence(), line, re.ASCII):
            run.append((n, line))
            continue
        if run:
            out += [(run[0][0], i, False, x) for i, x in run]
            if len(run) > 1:
                out.append((run[0][0], run[0][0], True, "\n".join(x for _, x in run)))
        run = []
    return out


def brute(text):
    """The set of families and the number of notices of one text."""
    vocabulary, weights, bias, sharp = licenses.model()
    number, held = {g: i for i, g in enumerate(vocabulary)}, [{g for t in licenses.TEMPLATES[f] for g in licenses.grams(t)} for f in licenses.FAMILIES]
    by_run = {}
    for run, n, block, p in paragraphs(text):
        own = licenses.grams(p)
        z = (weights[[number[g] for g in own if g in number]].sum(axis=0) + bias) * sharp
        probability = licenses.softmax(z[None])[0]
        if probability[-1] >= licenses.LIKELY:
            continue
        c = int(np.argmax(z[:-1]))
        pairs = {g for g in own if " " in g}
        shared = {g for g in pairs if g in number and g in held[c]}
        shortest = max(1, min(len([g for g in licenses.grams(t) if " " in g]) for t in licenses.TEMPLATES[licenses.FAMILIES[c]]))
        match = max(len(shared) / max(1, len(pairs)), min(1, len(shared) / shortest))
        alone = any(g in number and [i for i, h in enumerate(held) if g in h] == [c] for g in own)
        family = licenses.FAMILIES[c] if probability[c] >= licenses.LIKELY and match >= licenses.CONFIRMED and alone else "unknown"
        by_run.setdefault(run, []).append((block, family))
    out = []
    for found in by_run.values():
        whole = [f for block, f in found if block and f != "unknown"]
        as_one = bool(whole) and {f for block, f in found if not block} - {"unknown"} <= set(whole)
        out += [f for block, f in found if block == as_one]
    return ",".join(sorted(set(out))), len(out)


def test_whole_texts_and_unseen_phrasings(spark):
    texts = [MIT, GPL, BSD, "prose before\n" + GPL + "prose after\n\n" + BSD, *UNSEEN, *ORDINARY]
    got = results(spark, texts)
    assert [got[i].license for i in range(3)] == ["mit", "gpl", "bsd"] and got[1].n_notices == got[2].n_notices == 1 and got[3].licenses == "bsd,gpl"
    right = [got[4 + i].license == family for i, family in enumerate(UNSEEN.values())]
    assert sum(right) >= len(right) - 1, [(t, got[4 + i].licenses) for i, t in enumerate(UNSEEN)]
    assert all(got[4 + len(UNSEEN) + i].license is None for i in range(len(ORDINARY)))


def test_scan_equals_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    import random

    rng = random.Random(4)
    pool = [*MIT.split("\n"), *GPL.split("\n"), *BSD.split("\n"), *UNSEEN, *ORDINARY, "", "İK licence ſoftware", "a\x00b license", "one more ordinary line"]
    texts = [MIT, GPL, BSD, None, "", "license " * 5000, *docs[:400], *("\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(300))]
    got = results(spark, texts)
    for i, t in enumerate(texts):
        assert (got[i].licenses, got[i].n_notices) == brute(t), t
