"""License scans by conditional compression.

Every place of a text that has a word of license wordings opens a window as long as the longest template to both
sides; windows that meet are one candidate block. A block is compressed alone and once with each template as the
raw dictionary; templates are ranked by the bytes that they save. Those that save enough are confirmed, best first,
by an alignment of their words with the block's: the exact insertions, deletions and substitutions are found
and must stay below a share of the template's words. Places of one block that are taken are not used again.

Case, white space and punctuation at the ends of words are not compared. Null and empty texts, and texts without
a word of the list, have no candidates. Repeated rows give repeated findings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.llm.words import slices

# Fixed wordings of public licenses and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SPDX MIT": "SPDX-License-Identifier: MIT",
    "SPDX Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "Rights reserved": "All rights reserved.",
}
HINT = "(?i)licen[sc]e|copyright|spdx|permission is hereby|rights reserved|redistribut"


@dataclass(frozen=True)
class Scan:
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    hint: str = HINT
    least_saved: int = 6
    most_changed: int = 6
    level: int = 3


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _words(text: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) without punctuation at its ends; words of punctuation alone are left out."""
    out = []
    for m in re.finditer(r"\S+", text):
        word = m.group()
        core = re.sub(r"^\W+|\W+$", "", word)
        if core:
            at = m.start() + word.index(core)
            out.append((core.lower(), at, at + len(core)))
    return out


def windows(text: str, hint: re.Pattern, reach: int) -> list[tuple[int, int]]:
    """Merged windows around every hint, widened to whole words."""
    out: list[list[int]] = []
    for m in hint.finditer(text):
        begin, end = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    found = []
    for begin, end in out:
        while begin and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if found and begin <= found[-1][1]:
            found[-1] = (found[-1][0], end)
        else:
            found.append((begin, end))
    return found


def alignment(template: list[str], block: list[str], blocked: np.ndarray) -> tuple[int, int, int]:
    """(differences, begin, end): the run of block words closest to the template, the first of equals.

    Words in ``blocked`` places match nothing. One row for each template word, all ends of runs at once.
    """
    n = len(block)
    known = {w: i for i, w in enumerate(dict.fromkeys(template))}
    ids = np.array([known.get(w, -1) for w in block], dtype=np.int64)
    ids[blocked] = -2
    cost, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    for k, word in enumerate(template):
        change = cost[:-1] + (ids != known[word])
        drop = cost[1:] + 1
        new = np.concatenate(([k + 1], np.minimum(change, drop)))
        from_ = np.concatenate(([0], np.where(change <= drop, begin[:-1], begin[1:])))
        # An inserted block word costs one: the running minimum of cost minus place.
        level = new - np.arange(n + 1)
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, np.arange(n + 1), 0))
        cost, begin = best + np.arange(n + 1), from_[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def differences(template: list[str], found: list[str]) -> list[str]:
    """The exact wording differences, in order: -word, +word or word>word."""
    a, b = len(template), len(found)
    cost = np.zeros((a + 1, b + 1), dtype=np.int64)
    cost[:, 0], cost[0, :] = np.arange(a + 1), np.arange(b + 1)
    for i in range(a):
        for j in range(b):
            cost[i + 1, j + 1] = min(cost[i, j] + (template[i] != found[j]), cost[i, j + 1] + 1, cost[i + 1, j] + 1)
    out, i, j = [], a, b
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (template[i - 1] != found[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != found[j]:
                out.append(f"{template[i]}>{found[j]}")
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(f"-{template[i]}")
        else:
            j -= 1
            out.append(f"+{found[j]}")
    return out[::-1]


def scan(docs: DataFrame, s: Scan = Scan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, begin, end, saved, rank, n_differences, differences) of every confirmed notice.

    ``begin`` and ``end`` count code points; ``saved`` are the bytes that the template saves in its block.
    """
    reach = max(map(len, s.templates.values()), default=0)

    def run(batches):
        hint = re.compile(s.hint)
        alone = zstandard.ZstdCompressor(level=s.level)
        given = {
            k: zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(_plain(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, v in s.templates.items()
        }
        tokens = {k: [w for w, _, _ in _words(v)] for k, v in s.templates.items()}
        for batch in slices(batches, 1):
            rows = []
            for place, value in enumerate(batch.column(1).to_pylist()):
                for low, high in windows(value or "", hint, reach):
                    rows += [(place, *r) for r in _confirmed(value[low:high], low, s, alone, given, tokens)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            columns += [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "begin", "end", "saved", "rank", "n_differences", "differences"])

    kind = docs.schema[doc_id].dataType.simpleString()
    some = docs.where(F.col(text).rlike(s.hint)).select(F.col(doc_id), F.col(text))
    return some.mapInArrow(run, f"doc_id {kind}, license string, begin long, end long, saved int, rank int, n_differences int, differences array<string>")


def _confirmed(block: str, low: int, s: Scan, alone, given, tokens) -> list[tuple]:
    plain = _plain(block).encode()
    size = len(alone.compress(plain))
    saved = {k: size - len(c.compress(plain)) for k, c in given.items()}
    ranked = sorted((k for k in saved if saved[k] >= s.least_saved), key=lambda k: (-saved[k], k))
    words = _words(block)
    only = [w for w, _, _ in words]
    taken = np.zeros(len(words), dtype=bool)
    out = []
    for rank, name in enumerate(ranked, 1):
        wanted = tokens[name]
        while True:
            changed, begin, end = alignment(wanted, only, taken)
            if changed * s.most_changed > len(wanted) or end <= begin or taken[begin:end].any():
                break
            taken[begin:end] = True
            out.append((name, low + words[begin][1], low + words[end - 1][2], saved[name], rank, changed, differences(wanted, only[begin:end])))
    return sorted(out, key=lambda r: r[1:3])
