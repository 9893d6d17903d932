"""License scans by conditional compression (operator 4).

Spark keeps the texts that hold a word of license language; in them, candidate blocks are
the stretches of up to ``REACH`` words around such words (overlapping ones merge).  Each
block is compressed by zstandard with every template as a raw dictionary; templates are
ranked by how much the block shrinks against its size without a dictionary.  Down this
ranking they are confirmed by exact wording (an SPDX tag line names its license and needs no
template): words of the template that the block lacks,
and words in between that it adds.  Words that tell licenses apart (names of licenses and of
their families, and all words with a digit: versions, clause counts) are its identity: the
place must hold those of the template, in order, and no others, so a notice of a version or
variant without a template is not named as its neighbour.  Every template whose words
the block can hold (a lower bound on missing words) is compared, and the one with the most words explained less differences wins (so a short
notice does not win over a longer one that begins with it).  A
block may hold several notices; what a winner explains is taken out and the rest is ranked
again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import arrow_rows, bounded_batches

#: Notices by which public licenses are commonly stated, and their kind.
TEMPLATES = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met:"),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-1.0", "copyleft", "This work is licensed under the GNU General Public License, version 1."),
    ("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("ISC", "permissive", "Licensed under the ISC License."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-3.0", "permissive", "Licensed under CC BY 3.0."),
    ("CC-BY-ND-4.0", "noderivatives", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "restricted", "All rights reserved."),
    ("proprietary", "restricted", "All rights reserved. No part of this work may be reproduced without permission."),
]
CUE = r"(?i)licen[sc]e|sublicens|copyright|spdx|creative commons|\bcc[ -](by|0)|public domain|rights reserved|permission|redistribut|free software"
#: Kind of each license with a template; a tag line names its license itself.
KINDS = {name: kind for name, kind, _ in TEMPLATES}
_SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)")
REACH, MISSING, ADDED, LEVEL = 60, 0.1, 0.2, 3
_CUE, _WORD = re.compile(CUE), re.compile(r"[^\x20\x09-\x0D]+")


#: Words that name a license or a variant of one; words with a digit count too.
IDENTITY = frozenset("""mit apache bsd isc boost gnu general lesser library affero gpl lgpl agpl mpl mozilla eclipse cc cc0 by-sa by-nc by-nd
by-nc-sa by-nc-nd zero noncommercial noderivatives noderivs sharealike artistic unlicense zlib""".split())


def identity(words: list[str]) -> list[str]:
    """The identity words of normalised words, in order."""
    return [w for w in words if w in IDENTITY or any("0" <= c <= "9" for c in w)]


def normal(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>*#")


def _ranker(templates):
    kit = []
    for k, (name, kind, text) in enumerate(templates):
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kit.append((k, name, kind, [normal(w) for w in text.split()], zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
    plain = zstandard.ZstdCompressor(level=LEVEL)

    def rank(block: str):
        raw = block.lower().encode()
        alone = len(plain.compress(raw))
        shrunk = sorted((len(c.compress(raw)) / alone, k) for k, _, _, _, c in kit)
        return [(1 - r, *kit[k][1:4]) for r, k in shrunk]

    return rank


def wording(template: list[str], words: list[str]):
    """(first word, end, missing, added) of the template's place in ``words``; None if it
    shares nothing."""
    longest = SequenceMatcher(None, template, words, autojunk=False).find_longest_match()
    if not longest.size:
        return None
    slack = int(ADDED * len(template))
    lo = max(0, longest.b - longest.a - slack)
    near = words[lo:max(lo, longest.b - longest.a + len(template) + slack)]
    parts = [m for m in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if m.size]
    start, end = lo + parts[0].b, lo + parts[-1].b + parts[-1].size
    same = sum(m.size for m in parts)
    return start, end, len(template) - same, end - start - same


def blocks(text: str) -> list[list[re.Match]]:
    """Words within REACH of a cue, as merged stretches of word matches."""
    words = list(_WORD.finditer(text))
    out: list[list[int]] = []
    at = 0
    for cue in _CUE.finditer(text):
        while at < len(words) and words[at].end() <= cue.start():
            at += 1
        lo, hi = max(0, at - REACH), min(len(words), at + REACH + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    # A stretch of any length is worked through in overlapping parts of bounded size.
    step = 8 * REACH
    return [words[i:min(hi, i + step + 2 * REACH)] for lo, hi in out for i in range(lo, hi, step) if i == lo or hi - i > 2 * REACH]


def scan_text(text: str, rank) -> list[tuple[int, int, str, str, float, int, int]]:
    """(start, end, license, kind, reduction, missing, added) of each confirmed notice, in
    code points; overlapping finds keep the first."""
    found = [(m.start(), m.end(), m.group(1), KINDS.get(m.group(1), "declared"), 1.0, 0, 0) for m in _SPDX.finditer(text)]
    for block in blocks(text):
        stretches = [block]
        while stretches:
            ws = stretches.pop()
            if not ws or not _CUE.search(text, ws[0].start(), ws[-1].end()):
                continue
            norm = [normal(w.group()) for w in ws]
            fits, held = [], Counter(norm)
            for reduction, name, kind, template in rank(text[ws[0].start():ws[-1].end()]):
                if (Counter(template) - held).total() > MISSING * len(template):
                    continue
                w = wording(template, norm)
                # a version may stand right after the place, which ends with a shared word
                if w and w[2] <= MISSING * len(template) and w[3] <= ADDED * len(template) and identity(norm[w[0]:w[1]]) == identity(template):
                    fits.append((w, name, kind, reduction, len(template)))
            if fits:  # the most words explained less differences, then the larger reduction
                (a, b, missing, added), name, kind, reduction, _ = max(fits, key=lambda x: x[4] - 2 * x[0][2] - x[0][3])
                found.append((ws[a].start(), ws[b - 1].end(), name, kind, reduction, missing, added))
                stretches += [ws[:a], ws[b:]]
    out = []
    for f in sorted(found):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(``id_col``, ``start``, ``end``, ``license``, ``kind``, ``reduction``, ``n_missing``,
    ``n_added``) of every notice found, offsets in code points, end exclusive.

    Null and empty texts have none; repeated rows are scanned each; equal templates tie in
    the order given.  Empty table: no rows."""
    bounded_batches(docs.sparkSession)
    read = docs.where(F.col(text_col).rlike(CUE)).select(id_col, text_col)
    out = docs.select(id_col).schema.add("start", "long").add("end", "long").add("license", "string").add("kind", "string")
    out = out.add("reduction", "double").add("n_missing", "long").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _ranker(templates)
        for b in arrow_rows(batches):
            rows, found = [], []
            for i, t in enumerate(b[text_col].to_pylist()):
                f = scan_text(t, rank)
                rows += [i] * len(f)
                found += f
            cols = list(zip(*found, strict=True)) if found else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b[id_col].take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             out.names)

    return read.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
