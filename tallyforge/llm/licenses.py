"""Licence scan by sentence rules.

Known licence sentences are looked for as sequences of words (runs of letters and digits, in any case) that begin and end where a sentence
or a line does; line breaks, comment marks and punctuation between their words do not count, so wrapped texts and comments have them too. A known
sentence is a template in which ``<...>`` stands for up to eight words, such as a year or a holder. The identifiers of a text, in order, are then matched against ordered licence rules: a rule names the identifiers that must
follow each other, with at most ``slack`` sentences that are not known between them. Rules are tried in their order at each place, and
the first that holds takes its identifiers; known sentences that no rule takes are reported as ``unmatched``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers and sentences of public licences and notices.
SENTENCES = (
    ("APACHE2_NOTICE", "Licensed under the Apache License, Version 2.0"),
    ("APACHE2_NOTICE", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("APACHE2_YOU_MAY", "you may not use this file except in compliance with the License"),
    ("APACHE2_OBTAIN", "You may obtain a copy of the License at"),
    ("APACHE2_AS_IS", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT_NOTICE", "Released under the MIT License"),
    ("MIT_NOTICE", "Licensed under the MIT License"),
    ("MIT_NOTICE", "This project is licensed under the terms of the MIT License"),
    ("MIT_TITLE", "The MIT License"),
    ("MIT_TITLE", "MIT License"),
    ("MIT_GRANT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT_KEEP", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT_AS_IS", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("BSD_REDISTRIBUTE", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD_ENDORSE", "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL3_NOTICE", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL_FREE", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL2_FREE", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL_HOPE", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("CC_BY_NC4", "Licensed under CC BY-NC 4.0"),
    ("CC_BY_NC4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC_BY4", "Licensed under CC BY 4.0"),
    ("CC_BY4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC_BY_SA4", "Licensed under CC BY-SA 4.0"),
    ("CC_BY_SA4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0"),
    ("MPL2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("RESERVED", "All rights reserved"),
)

#: Licences and the sequences of identifiers that tell them, longest first.
RULES = (
    ("MIT", ("MIT_TITLE", "MIT_GRANT", "MIT_KEEP", "MIT_AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_KEEP", "MIT_AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_KEEP")),
    ("BSD-3-Clause", ("BSD_REDISTRIBUTE", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_REDISTRIBUTE", "BSD_SOURCE", "BSD_BINARY")),
    ("Apache-2.0", ("APACHE2_NOTICE", "APACHE2_YOU_MAY", "APACHE2_OBTAIN", "APACHE2_AS_IS")),
    ("Apache-2.0", ("APACHE2_NOTICE",)),
    ("MIT", ("MIT_NOTICE",)),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_HOPE")),
    ("GPL-3.0-or-later", ("GPL_FREE",)),
    ("GPL-2.0-or-later", ("GPL2_FREE", "GPL_HOPE")),
    ("GPL-2.0-or-later", ("GPL2_FREE",)),
    ("GPL-3.0", ("GPL3_NOTICE",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC4",)),
    ("CC-BY-4.0", ("CC_BY4",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA4",)),
    ("CC0-1.0", ("CC0",)),
    ("MPL-2.0", ("MPL2",)),
    ("All-rights-reserved", ("RESERVED",)),
)

#: A sentence ends at a blank line (comment marks alone leave a line blank), at ; ! ? : and at a full stop before white space or the end.
_END = re.compile(r"[;!?:]+|\.(?=\s|$)|(?>\r\n?|\n)(?:[^\w\r\n]|_)*(?:\r\n?|\n)")
#: A known sentence begins after, and ends before, one of these, so also at a single line break; within it they are white space.
_EDGE = re.compile(r"[\n\r;!?:]+|\.(?=\s)")
_WORD = re.compile(r"[^\W_]+")
_BEGIN = re.compile(rf"(?:\A|{_EDGE.pattern})[\W_]*([^\W_]+)")
#: Comment marks that are words, at the beginning of a line, and what lies between two words.
_MARKS = ("rem", "dnl", "c")
_GAP = rf"(?:[\W_]*[\r\n][ \t]*(?:{'|'.join(_MARKS)})[ \t][\W_]*|(?>[\W_]+))"
_STOP = r"(?![^\W_])(?=[\W_]*?([\n\r;!?:]|\.(?=\s|\Z)|\Z))"
SCHEMA = "id long, license string, first_sentence int, last_sentence int, sentence_ids array<string>, start int, stop int"


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


class Sentences:
    """Known sentences as sequences of words, by their first word. What stands between the words of one does not count."""

    def __init__(self, known: tuple[tuple[str, str], ...] = SENTENCES):
        self.by_first: dict[str, list[tuple[str, re.Pattern]]] = {}
        hole = "holeinatemplate"
        for name, text in known:
            words = normalise(re.sub(r"<[a-z]+>", hole, text)).split(" ")
            shape = _GAP.join(rf"[^\W_]+(?:{_GAP}[^\W_]+){{0,7}}?" if w == hole else re.escape(w) for w in words)
            self.by_first.setdefault("" if words[0] == hole else words[0], []).append((name, re.compile(shape + _STOP, re.I)))

    def find(self, text: str) -> Iterator[tuple[str, int, int, int, int]]:
        """Identifier, begin (after the edge before it), first word's place, last word's end, and stop (before the edge after it) of the longest known sentence at each place; they do not overlap."""
        over = 0
        for m in _BEGIN.finditer(text):
            for at in _begins(text, m):
                near = (*self.by_first.get(_WORD.match(text, at)[0].lower(), ()), *self.by_first.get("", ()))
                best = max(((hit.end(), -k) for k, (_, shape) in enumerate(near) if at >= over and (hit := shape.match(text, at))), default=None)
                if best:
                    name, shape = near[-best[1]]
                    begin = max((e.end() for e in _EDGE.finditer(text, m.start(), at)), default=0)
                    over = best[0]
                    yield name, begin, at, over, shape.match(text, at).start(1)
                    break

    def identify(self, normal: list[str]) -> list[str | None]:
        """The identifier of each sentence, or None; one that was cut into parts has it at its last part."""
        out: list[str | None] = [None] * len(normal)
        text = "\n".join(normal)
        for name, _, _, over, _ in self.find(text):
            out[text.count("\n", 0, over)] = name
        return out


def _begins(text: str, m: re.Match) -> Iterator[int]:
    """Where a known sentence may begin: at the first word after an edge, or behind it if it is a comment or list mark."""
    yield m.start(1)
    mark = m[1].lower() in _MARKS or (len(m[1]) <= 4 and text[m.end() : m.end() + 1] in (")", "]", "."))
    if mark and (after := _WORD.search(text, m.end())):
        yield after.start()


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences, without those that have no words."""
    at = 0
    for m in _END.finditer(text):
        if _WORD.search(text, at, m.start()):
            yield at, m.start()
        at = m.end()
    if _WORD.search(text, at):
        yield at, len(text)


def match_rules(found: list[tuple[int, str]], rules: tuple[tuple[str, tuple[str, ...]], ...], slack: int) -> Iterator[tuple[str, int, int]]:
    """``found``: places, counted in sentences, and identifiers in order. Gives licence, first and last place in ``found``."""
    k = 0
    while k < len(found):
        for license, names in rules:
            n = len(names)
            run = found[k : k + n]
            if tuple(x[1] for x in run) == names and all(b[0] - a[0] <= slack + 1 for a, b in zip(run, run[1:])):
                yield license, k, k + n - 1
                k += n
                break
        else:
            yield "unmatched", k, k
            k += 1


def scan_licenses(docs: DataFrame, *, known: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES, slack: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per licence found: ``id_col, license, first_sentence, last_sentence, sentence_ids, start, stop`` (code points).

    Null and empty texts have none. Each row is scanned on its own, whole, so repeated rows and null ids give their own
    results; equal evidence at one place goes to the rule that stands first; an empty table gives no rows; other columns are ignored. The
    scan is one pass without a shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Sentences(known)
        hint = re.compile("|".join(sorted({re.escape(w) for w in _hints(known)})), re.I)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("id"), batch.column("text")):
                text = text.as_py()
                if not text or not hint.search(text):
                    continue
                hits = list(lookup.find(text))
                if not hits:
                    continue
                starts = [a for a, _ in sentences(text)]
                number = [(bisect_right(starts, first) - 1, bisect_right(starts, over - 1) - 1) for _, _, first, over, _ in hits]
                found, at = [], 0
                for k, hit in enumerate(hits):
                    # Only sentences without known ones count between two.
                    at += 1 + max(0, number[k][0] - number[k - 1][1] - 1) if k else 0
                    found.append((at, hit[0]))
                for license, first, last in match_rules(found, rules, slack):
                    out.append((doc.as_py(), license, number[first][0], number[last][1], [x[1] for x in found[first : last + 1]], hits[first][1], hits[last][4]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, _TYPES)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA).withColumnRenamed("id", id_col)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()]


def _hints(known: tuple[tuple[str, str], ...]) -> set[str]:
    """Words of which every known sentence holds one: the fewest needed, chosen greedily. Texts without any hold no known sentence."""
    left = [set(w for w in _WORD.findall(re.sub("<[a-z]+>", " ", text).lower()) if len(w) >= 3) or {""} for _, text in known]
    chosen: set[str] = set()
    while left:
        votes: dict[str, int] = {}
        for ws in left:
            for w in ws:
                votes[w] = votes.get(w, 0) + 1
        best = max(votes, key=lambda w: (len(w) >= 6, votes[w], len(w), w))
        chosen.add(best)
        left = [ws for ws in left if best not in ws]
    return chosen
