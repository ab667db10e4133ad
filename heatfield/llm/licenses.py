"""License scans by conditional compression.

Templates are short notices, headers and bodies of licences, each with words that identify it. Candidate blocks are the
stretches of about a template's length that hold all its identifying words; comment marks are left out, so notices may
be wrapped. Every block is compressed alone and with each template as a raw zstandard dictionary, and the templates are
ranked by the bytes that they save. Down the ranking, a template is confirmed by exact wording: block and template are aligned
word by word, and at most MAX_DIFF of the template's words may be missing and as many be extra, none of them identifying.
The first one that holds names the block; of blocks that overlap the one that saves most bytes stays. A template is not
confirmed on a block much longer than itself, as it has blocks of its own there. Nothing but the identifying words, which a
confirmed notice must have, keeps a text from being scanned.

Defined results: null and empty texts have no candidates; equal lines repeat their result at each place, and repeated rows
theirs; ties go to the fewest differences, then to the name that sorts first; gain is the share of the block's compressed
bytes that the template saves; a null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate
from operator import and_, or_

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import small_batches

#: Customary short notices.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License. Redistribution and use in source and binary forms are permitted.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Neither the name of the copyright holder may be used to endorse products.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under the CC0 1.0 license.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
_GNU = "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Headers and bodies of licences, with the words that must be there, the rarest first.
BODIES = [
    ("AGPL-3.0", "affero gnu general public 3", _GNU.format(colon=":", kind="Affero ", version="3")),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "redistribution redistributions binary", _BSD),
    ("BSD-3-Clause", "redistribution redistributions binary endorse neither", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "gnu general public 2", _GNU.format(colon=";", kind="", version="2")),
    ("GPL-3.0", "gnu general public 3", _GNU.format(colon=":", kind="", version="3")),
    ("LGPL-3.0", "lesser gnu general public 3", _GNU.format(colon=":", kind="Lesser ", version="3")),
    ("MIT", "sublicense permission granted charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: What begins and ends a line of a comment.
_MARKS = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|(?:REM|dnl)(?=[ \t]))?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$", re.I)
MAX_DIFF, SLACK = 0.2, 2
#: Words that must be there, the rarest first, and words that name another licence.
NEED = {
    "AGPL-3.0": "affero gnu general public 3",
    "Apache-2.0": "apache 2.0",
    "BSD-2-Clause": "2-clause bsd",
    "BSD-3-Clause": "3-clause bsd",
    "CC-BY-4.0": "cc by 4.0",
    "CC-BY-NC-4.0": "cc by-nc 4.0",
    "CC-BY-SA-4.0": "cc by-sa 4.0",
    "CC0-1.0": "cc0 1.0",
    "GPL-2.0": "gnu general public 2",
    "GPL-3.0": "gnu general public 3",
    "LGPL-3.0": "lesser gnu general public 3",
    "MIT": "mit license",
    "MPL-2.0": "mozilla 2.0",
}
OTHER = {w for v in NEED.values() for w in v.split()} | {"library", "not", "no", "except", "by-nd", "by-nc-nd", "by-nc-sa"}
_WORD = re.compile(r"[\w.\-]*\w")
SCHEMA = "doc_id long, line_no int, license string, gain double, missing array<string>, extra array<string>, line string"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _aligned(template: list[str], line: list[str]) -> list:
    """Matching blocks; those at the ends that lie further off than they are long are left out."""
    blocks = [b for b in SequenceMatcher(None, template, line, autojunk=False).get_matching_blocks() if b.size]
    while len(blocks) > 1 and blocks[1].b - blocks[0].b - blocks[0].size > blocks[0].size:
        blocks.pop(0)
    while len(blocks) > 1 and blocks[-1].b - blocks[-2].b - blocks[-2].size > blocks[-1].size:
        blocks.pop()
    return blocks


def differences(template: list[str], line: list[str], blocks: list | None = None) -> tuple[list[str], list[str]]:
    """Words of the template that the line lacks, and words that the line has between matching ones."""
    blocks = _aligned(template, line) if blocks is None else blocks
    if not blocks:
        return template, []
    hit_t = {i for b in blocks for i in range(b.a, b.a + b.size)}
    hit_l = {i for b in blocks for i in range(b.b, b.b + b.size)}
    span = range(blocks[0].b, blocks[-1].b + blocks[-1].size)
    return [w for i, w in enumerate(template) if i not in hit_t], [line[i] for i in span if i not in hit_l]


class Scanner:
    def __init__(self, templates: dict[str, str], bodies: list[tuple[str, str, str]] = ()):
        self.known = [(k, _words(v), self.need(k, _words(v)), self.dictionary(v)) for k, v in templates.items()]
        self.known += [(k, _words(v), need.split(), self.dictionary(v)) for k, need, v in bodies]
        self.plain = zstandard.ZstdCompressor(level=3)

    @staticmethod
    def need(name: str, words: list[str]) -> list[str]:
        return NEED[name].split() if name in NEED and set(NEED[name].split()) <= set(words) else [max(words, key=len)]

    @staticmethod
    def dictionary(text: str) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """First word and end of each candidate block."""
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        found = set()
        for _, template, need, _ in self.known:
            if not all(w in places for w in need):
                continue
            room = int(MAX_DIFF * len(template)) + SLACK
            for j in [i for i, w in enumerate(template) if w == need[0]]:
                for p in places[need[0]]:
                    lo, hi = max(p - j - room, 0), min(p - j + len(template) + room, len(words))
                    if set(need) <= set(words[lo:hi]):
                        found.add((lo, hi))
        return sorted(found)

    def ranked(self, raw: bytes) -> tuple[int, list[tuple[int, str, int]]]:
        """Compressed bytes of a block alone; bytes saved (less is more), name and number of each template, the best first."""
        alone = len(self.plain.compress(raw))
        return alone, sorted((len(squeeze.compress(raw)) - alone, name, k) for k, (name, _, _, squeeze) in enumerate(self.known))

    def confirmed(self, k: int, window: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """First and last word of the notice of template k in a block, missing and extra words; None if it is none."""
        _, template, need, _ = self.known[k]
        most = MAX_DIFF * len(template)
        if len(window) > len(template) + 2 * (int(most) + SLACK) or not set(need) <= set(window):
            return None
        blocks = _aligned(template, window)
        missing, extra = differences(template, window, blocks)
        if len(missing) > most or len(extra) > most or set(missing) & set(need) or set(extra) & OTHER:
            return None
        return blocks[0].b, blocks[-1].b + blocks[-1].size - 1, missing, extra

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, gain, missing, extra) of each notice, by place; start and end in characters."""
        marks = list(_WORD.finditer(text))
        words = [m.group().lower() for m in marks]
        found = []
        for lo, hi in self.blocks(words):
            alone, ranked = self.ranked(text[marks[lo].start() : marks[hi - 1].end()].encode("utf-8", "replace"))
            for less, name, k in ranked:
                if hit := self.confirmed(k, words[lo:hi]):
                    first, last, missing, extra = hit
                    found.append((less, len(missing) + len(extra), name, marks[lo + first].start(), marks[lo + last].end(), -less / alone, missing, extra))
                    break
        taken: list[tuple] = []
        for _, _, name, start, end, gain, missing, extra in sorted(found):
            if all(end <= a or b <= start for a, b, *_ in taken):
                taken.append((start, end, name, gain, missing, extra))
        return sorted(taken)

    def lines(self, text: str) -> list[tuple]:
        """(line_no, license, gain, missing, extra, its lines) of each notice in a text, comment marks left out."""
        lines = text.split("\n")
        bare = [_MARKS.sub("", x) for x in lines]
        starts = list(accumulate((len(x) + 1 for x in bare), initial=0))
        out = []
        for start, end, *rest in self.scan("\n".join(bare)):
            a, b = bisect_right(starts, start) - 1, bisect_right(starts, end - 1)
            out.append((a, *rest, "\n".join(lines[a:b])))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """SCHEMA, one row for each known notice in docs(doc_id, text); line has all lines of the notice, line_no is the first."""
    small_batches(docs.sparkSession)
    known, bodies = dict(templates or TEMPLATES), [] if templates else BODIES
    low = F.lower("text")
    holds = [reduce(and_, [low.contains(w) for w in need]) for _, _, need, _ in Scanner(known, bodies).known]
    rows = docs.filter(reduce(or_, holds)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(known, bodies)
        for batch in batches:
            got = [(d, *r) for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in s.lines(text)]
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            cols = list(zip(*got, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "line_no", "license", "gain", "missing", "extra", "line"])

    return rows.mapInArrow(scan, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES, ORACLES = {"op6_license_scan": op6_license_scan}, {}
