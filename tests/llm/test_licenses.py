"""License scans: planted notices with known wording, and clean texts."""

import random

from hirelake.llm import licenses as L

RND = random.Random(6)


def filler(n):
    return " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) for _ in range(n))


def found(text):
    return [(f[2], f[5], f[6], text[f[0]:f[1]]) for f in L.scan_text(text, L._ranker(L.TEMPLATES))]


def test_every_template_is_found_as_itself():
    for name, _, t in L.TEMPLATES:
        got = found(f"{filler(90)}\n{t}\n{filler(90)}")
        assert [(g[0], g[1], g[2]) for g in got] == [(name, 0, 0)], (name, got)
        assert L.normal(got[0][3].split()[0]) == L.normal(t.split()[0])


def test_changed_wording():
    long = L.TEMPLATES[2][2]
    words = long.split()
    words[20] = "changed"
    assert [(g[0], g[1]) for g in found(" ".join(words))] == [("MIT", 1)]
    assert [g[0] for g in found(long.upper().replace(" ", "\n  "))] == ["MIT"]
    assert found("Permission is hereby granted " + filler(60)) == []
    assert found("the copyright of " + filler(40)) == []


def test_near_templates_are_told_apart_and_several_in_one_block():
    t = f"Licensed under CC BY-SA 4.0. {filler(3)} Licensed under CC BY-NC 4.0. {filler(2)} This work is licensed under the GNU General Public License, version 2."
    assert [g[0] for g in found(t)] == ["CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0"]


def test_long_stretch_of_cues():
    t = ("license " * 3000) + "Released under the MIT License. " + ("license " * 3000)
    assert [g[0] for g in found(t)] == ["MIT"]


def test_spark_scan(spark):
    note = "Released under the MIT License."
    df = spark.createDataFrame([(1, f"é\U0001f600 {note} x", "a"), (1, f"é\U0001f600 {note} x", "a"), (None, note, "b"), (3, None, "c"), (4, "", None), (5, filler(50), "d")],
                               "doc_id bigint, text string, license string")
    got = sorted((str(r.doc_id), r.start, r.end, r.license, r.n_missing) for r in L.scan(df).collect())
    assert got == [("1", 3, 3 + len(note), "MIT", 0)] * 2 + [("None", 0, len(note), "MIT", 0)]
    assert L.scan(df.limit(0)).count() == 0


def test_all_documents(spark):
    """Every line that is a notice by itself is found, and nothing where no cue stands."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = {t: n for n, _, t in L.TEMPLATES}
    want = sorted((i, names[x]) for i, t in docs.items() for x in t.split("\n") if x in names)
    got = sorted((r.doc_id, r.license) for r in L.query(spark, sf).collect())
    assert want and got == want


def test_bare_rights_reserved_line_and_the_longer_notice():
    assert found(f"{filler(90)}\nAll rights reserved.\n{filler(90)}") == [("proprietary", 0, 0, "All rights reserved.")]
    whole = L.TEMPLATES[-1][2].replace("work", "book")
    assert found(f"{filler(30)} {whole} {filler(30)}") == [("proprietary", 1, 1, whole)]


def test_every_line_with_a_cue_is_found(spark):
    """No notice line of the documents is left out, whether or not it equals a template."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = sorted((i, x) for i, t in docs.items() for x in t.split("\n") if L._CUE.search(x))
    got = sorted((r.doc_id, docs[r.doc_id][r.start:r.end] + ".") for r in L.query(spark, sf).collect())
    assert len(want) > 40 and [(i, x.rstrip(".")) for i, x in want] == [(i, x.rstrip(".")) for i, x in got]


def test_every_template_that_can_fit_is_compared():
    """The right one of many that differ in one word wins, wherever it ranks."""
    text = "This work is licensed under the GNU General Public License, version {}"
    many = [(f"v{k}", "copyleft", text.format(k) + ".") for k in range(100, 160)]
    many.append(("none", "copyleft", "nothing of this is in the text"))

    class Ranked:
        def __call__(self, block):
            return [(0.5, n, kind, [L.normal(w) for w in t.split()]) for n, kind, t in many]

    got = L.scan_text(f"{filler(20)} {text.format(159)}. {filler(20)}", Ranked())
    assert [(g[2], g[5], g[6]) for g in got] == [("v159", 0, 0)]


NAMED = [
    ("This work is licensed under the GNU General Public License, version 1.", "GPL-1.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 4.", None),
    ("This work is licensed under the GNU General Public License.", None),
    ("This work is licensed under the GNU Lesser General Public License, version 2.", None),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 1.", None),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.0.", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under the BSD 4-Clause License.", None),
    ("Licensed under the MIT License.", "MIT"),
    ("Licensed under the ISC License.", "ISC"),
    ("Licensed under the XYZ License.", None),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Distributed under the Boost Software License, Version 2.0.", None),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY 2.0.", None),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("All rights reserved.", "proprietary"),
    ("All rights are reserved for members of the club.", None),
    ("Permission to speak was granted.", None),
]


def test_versions_and_variants_are_not_named_as_their_neighbours():
    rank = L._ranker(L.TEMPLATES)
    for text, want in NAMED:
        for before, after in (("", ""), ("Some words 3 before it.\n", "\nAnd more words 2.0 after it, by someone.")):
            assert [f[2] for f in L.scan_text(before + text + after, rank)] == ([want] if want else []), text
