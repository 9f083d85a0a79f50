"""License scans by template markup.

A template is the mandatory wording of a license or notice with two kinds of markup: ``[ ... ]`` around words that may be
left out, and ``{m,n}`` for m to n words of any kind. It is compiled into an automaton over words (states are places in the
template; optional parts are jumps, replaceable parts count words). A text is accepted where the automaton reaches its end,
so all mandatory words must match exactly and in order. Texts are narrowed to the places of a template's first words before
the automaton runs. Apart from that, the places of a few fixed phrases are counted.

Null and empty texts have no words. Rows are judged one by one; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.textkit import text_slices

#: Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0 [the license]",
    ],
    "apache-2.0-notice": [
        "you may not use {1,6} except in compliance with the license you may obtain a copy of the license at [http] [https] [www] apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl-2.0-notice": [
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version 2 [of the license] [or at your option any later version]",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3 [0] [or [at your option any] later [version]]",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl-2.1-notice": [
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [either] version 2 1 [of the license] [or at your option any later version]",
    ],
    "lgpl-3.0-notice": [
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [either] version 3 [of the license] [or at your option any later version]",
    ],
    "agpl-3.0-notice": [
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation [either] version 3 [of the license] [or at your option any later version]",
    ],
    "gpl-warranty": [
        "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [lesser] [affero] general public license for more details",
    ],
    "mpl-2.0-notice": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [http] [https] [www] mozilla org mpl 2 0",
    ],
    "cc-by-4.0": [
        "licensed under [a] [creative commons] cc by 4 0 [international] [license]",
        "licensed under [a] [the] creative commons attribution 4 0 international [public] [license]",
    ],
    "cc-by-nc-4.0": [
        "licensed under [a] [creative commons] cc by nc 4 0 [international] [license]",
        "licensed under [a] [the] creative commons attribution noncommercial 4 0 international [public] [license]",
        "licensed under [a] [the] creative commons attribution non commercial 4 0 international [public] [license]",
    ],
    "cc-by-sa-4.0": [
        "licensed under [a] [creative commons] cc by sa 4 0 [international] [license]",
        "licensed under [a] [the] creative commons attribution sharealike 4 0 international [public] [license]",
        "licensed under [a] [the] creative commons attribution share alike 4 0 international [public] [license]",
    ],
    "cc0-1.0": [
        "to the extent possible under law {1,12} waived all copyright and related or neighboring rights to",
    ],
    "mit-notice": ["released under the [terms of the] mit license"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software [the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {1,12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]",
    ],
    "isc-text": [
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [the software is provided as is and {1,8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {1,8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]",
    ],
    "0bsd-text": [
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted the software is provided as is and {1,8} disclaims all warranties with regard to this software",
    ],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3] neither the name of {1,20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]",
    ],
    "bsd-3-clause": [
        "neither the name of {1,20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-disclaimer": [
        "this software is provided by the {1,8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1,12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "bsl-1.0-text": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ],
    "zlib-text": [
        "this software is provided as is without any express or implied warranty in no event will {1,8} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
    "unlicense-text": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
}


@dataclass
class Automaton:
    """``steps[s]``: (word or None for any, next state); ``jumps[s]``: states reached without a word; the last state accepts.

    ``needed``: the words outside all ``[ ]``, without which the last state can't be reached.
    """

    label: str
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    jumps: list[list[int]] = field(default_factory=lambda: [[]])
    needed: set[bytes] = field(default_factory=set)

    def grow(self) -> int:
        self.steps.append([])
        self.jumps.append([])
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.jumps[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return out

    def first_words(self) -> set[bytes | None]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s]}

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted stretch from ``start``."""
        end, last = None, len(self.steps) - 1
        now = self.closure({0})
        for i in range(start, len(words) + 1):
            if last in now:
                end = i
            if i == len(words):
                break
            now = self.closure({t for s in now for w, t in self.steps[s] if w is None or w == words[i]})
            if not now:
                break
        return end


def compile_template(label: str, markup: str) -> Automaton:
    out, now, opened = Automaton(label), 0, []
    for item in re.findall(r"\[|\]|\{\d+,\d+\}|[^\s\[\]{}]+", markup):
        if item == "[":
            opened.append(now)
        elif item == "]":
            out.jumps[opened.pop()].append(now)
        elif item[0] == "{":
            low, high = map(int, item[1:-1].split(","))
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(now)
                nxt = out.grow()
                out.steps[now].append((None, nxt))
                now = nxt
            for s in skips:
                out.jumps[s].append(now)
        else:
            nxt = out.grow()
            out.steps[now].append((item.encode(), nxt))
            now = nxt
            if not opened:
                out.needed.add(item.encode())
    if opened:
        raise ValueError(f"unclosed [ in a template of {label}")
    return out


_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = [compile_template(label, x) for label, all_of in templates.items() for x in all_of]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.first = [a.first_words() for a in self.automata]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Places (start, label) of the phrases; accepted templates (start, end, label)."""
        places, accepted = [], []
        held = set(words)
        phrases = [(p, label) for p, label in self.phrases if held.issuperset(p)]
        need = [(a, first) for a, first in zip(self.automata, self.first) if held.issuperset(a.needed)]
        if not phrases and not need:
            return places, accepted
        for p, label in phrases:
            n = len(p)
            places += [(i, label) for i, w in enumerate(words) if w == p[0] and tuple(words[i : i + n]) == p]
        for a, first in need:
            for i, w in enumerate(words):
                if (w in first or None in first) and (end := a.match(words, i)) is not None:
                    accepted.append((i, end, a.label))
        return sorted(places), sorted(accepted)


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<start:int,end:int,label:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = [x.split()[0] for x in SCAN.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
    for batch in batches:
        rows = []
        for _, _, data, offsets in text_slices(batch.column(1)):
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = words_of(raw[a:b])
                places, accepted = scanner.scan(words)
                base = sorted({x for _, x in places})
                labels = sorted({*base, *(x for *_, x in accepted)})
                starts = [x for x, _ in places]
                score = 1.0 if accepted else 0.5 if places else 0.0
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [{"start": s, "end": e, "label": x} for s, e, x in accepted]))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, kinds)]], names=["id", *names])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score and the accepted templates' places.

    score: 1 where a template's wording is accepted, 0.5 where only a phrase occurs, else 0.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(_scan, f"id {kind}, {SCAN}").withColumnRenamed("id", id_col)
