"""License scans: template markup compiled to token automata.

A template is text with markup in the style of public license lists: ``<<beginOptional>> ... <<endOptional>>`` for wording
that may be missing, ``<<var;words="a-b">>`` for a to b replaceable words. It is compiled to a nondeterministic automaton
over word tokens; a text is accepted from a place on if a run reaches the end, so all mandatory wording matches exactly
and in order. Runs start only where a template's leading mandatory words stand, found by a search of the joined words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import bounded
from atlasweave.llm._text import pieces

# The phrases and labels that every scan reports.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Templates of public licenses and notices.
TEMPLATES = {
    "apache-2.0": 'licensed under the Apache License <<beginOptional>>version<<endOptional>> 2.0',
    "apache-2.0-notice": 'licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use this <<var;words="1-3">> except in compliance with the License',
    "cc-by-4.0": 'CC BY 4.0 <<beginOptional>>international<<endOptional>>',
    "cc-by-nc": 'CC BY NC <<beginOptional>><<var;words="1-2">><<endOptional>>',
    "cc-by-sa": 'CC BY SA <<beginOptional>><<var;words="1-2">><<endOptional>>',
    "creative-commons": 'licensed under a Creative Commons <<var;words="1-6">> <<var;words="0-2">> license',
    "gpl-2.0": 'GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 2',
    "gpl-3.0": 'GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 3',
    "lgpl": 'GNU Lesser General Public License',
    "agpl": 'GNU Affero General Public License',
    "mit-notice": '<<beginOptional>>released<<endOptional>> under the MIT license',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "bsd": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words="0-1">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;words="0-1">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "mit-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1-6">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED',
    "isc-whole": 'Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-6">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words="0-1">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;words="0-1">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;words="1-8">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words="0-1">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;words="0-1">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<var;words="0-1">> Neither the name of <<var;words="1-12">> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "zlib": 'This software is provided as-is, without any express or implied warranty. In no event will <<var;words="1-6">> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:',
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "cc0-1.0": 'CC0 1.0 <<beginOptional>>Universal<<endOptional>>',
    "apache-2.0-whole": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;words="1-3">> except in compliance with the License. You may obtain a copy of the License at <<var;words="1-10">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-notice": '<<var;words="0-3">> is free software <<var;words="0-1">> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation <<beginOptional>>, either<<endOptional>> version <<var;words="1-1">> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>',
    "lgpl-notice": '<<var;words="0-3">> is free software <<var;words="0-1">> you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation <<beginOptional>>, either<<endOptional>> version <<var;words="1-2">> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>',
    "mpl-2.0": 'subject to the terms of the Mozilla Public License, v. 2.0 <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at <<var;words="1-8">><<endOptional>>',
    "epl-2.0": 'made available under the terms of the Eclipse Public License <<beginOptional>>v<<endOptional>> 2.0',
    "copyright-reserved": 'copyright <<var;words="0-8">> all rights reserved',
    "spdx-identifier": 'SPDX License Identifier <<var;words="1-1">>',
}

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(r'<<(beginOptional|endOptional|var;words="(\d+)-(\d+)")>>')


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(_KEEP).split()


class Automaton:
    """States are numbered; ``on[s]`` maps a word to next states, ``any[s]`` are next states by any word, ``free[s]`` by none."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened, lead, leading = 0, [], [], True
        pos = 0
        for m in [*_MARKUP.finditer(template), None]:
            for w in words_of(template[pos : m.start() if m else len(template)]):
                nxt = self._state()
                self.on[at].setdefault(w, []).append(nxt)
                at = nxt
                if leading and not opened:
                    lead.append(w)
            if m is None:
                break
            pos = m.end()
            if m[1] == "beginOptional":
                opened.append(at)
                leading = leading and not lead
            elif m[1] == "endOptional":
                nxt = self._state()
                self.free[at].append(nxt)
                self.free[opened.pop()].append(nxt)
                at = nxt
            else:
                leading = leading and not lead
                low, high = int(m[2]), int(m[3])
                skips = []
                for i in range(high):
                    if i >= low:
                        skips.append(at)
                    nxt = self._state()
                    self.any[at].append(nxt)
                    at = nxt
                for s in skips:
                    self.free[s].append(at)
        if opened:
            raise ValueError("an optional region isn't closed")
        if not lead:
            raise ValueError("a template needs mandatory words")
        self.end, self.lead = at, b" " + b" ".join(lead) + b" "
        # words before the lead are optional or replaceable; runs start at the lead
        self.start = self._closure({next(s for s in range(len(self.on)) if lead[0] in self.on[s])})

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """Where the longest accepted run that starts at this word ends, or -1."""
        now, best = set(self.start), -1
        for i in range(at, len(words)):
            now = self._closure({t for s in now for t in (*self.on[s].get(words[i], ()), *self.any[s])})
            if self.end in now:
                best = i + 1
            if not now:
                break
        return best


def _starts(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which a phrase (with a space at both ends) stands; joined begins with a space."""
    at, number, done = joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", done, at)
        done = at
        yield number
        at = joined.find(phrase, at + 1)


def scan(text: str, automata: dict[str, Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Number of words, base places (start, label), and template matches (start, end, label) of one whole text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(s, label) for phrase, label in BASE.items() for s in _starts(joined, b" " + phrase.encode() + b" ")]
    found = [(s, e, label) for label, a in automata.items() if a.lead in joined for s in _starts(joined, a.lead) if (e := a.match(words, s)) >= 0]
    return len(words), sorted(base), sorted(found)


_SCHEMA = "doc_id long, n_words long, base array<struct<word:long,label:string>>, matches array<struct<first:long,last:long,label:string>>"


def license_places(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (places of base phrases), matches (word spans of accepted templates) of every row.

    Null and empty texts have no words and no places; rows that repeat give equal rows; a null id stays null; other columns
    are ignored. A text is scanned whole.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {k: Automaton(t) for k, t in templates.items()}
        for b in pieces(batches, 1):
            n, base, found = zip(*(scan(t or "", automata) for t in b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([[{"word": w, "label": x} for w, x in r] for r in base], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array([[{"first": s, "last": e - 1, "label": x} for s, e, x in r] for r in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])))], ["doc_id", "n_words", "base", "matches"])

    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, _SCHEMA)


def license_labels(docs: DataFrame) -> DataFrame:
    """The places as columns: n_base, first_word, last_word, base_labels, labels and score, the share of words in matches."""
    p = license_places(docs)
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    both = F.array_sort(F.array_distinct(F.concat("base.label", "matches.label")))
    widths = F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["last"] - m["first"] + 1) + F.when(F.size("matches") == 0, 2 * F.size("base")).otherwise(0)
    return p.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.col("n_words") == 0, 0.0).otherwise(F.least(F.lit(1.0), widths / F.col("n_words"))).alias("score"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))
