"""Licence scanning with template markup compiled to token automata."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that mark a licence by name, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label -> template. The wording is that of the public licence texts. ``[[ ... ]]`` is optional wording (nestable); ``{{name:pattern:min-max}}`` is a
#: replaceable region of min to max words, each matching the pattern. ``{name}`` in a label takes the region's words.
TEMPLATES: dict[str, str] = {
    "apache-{v}": "licensed under the apache license [[version]] {{v:[0-9]+:1-2}}",
    "gpl-{v}": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] [[version]] {{v:[0-9]+:1-2}}",
    "mit-notice": "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license",
    "cc-by{terms}-{v}": "licensed under [[a]] [[the]] [[creative commons]] cc by {{terms:nc|nd|sa:0-2}} {{v:[0-9]+:1-2}}",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this {{work:.+:1-6}} to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "[[including the next paragraph]] shall be included in all copies or substantial portions of the software"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies"
    ),
    "bsd-clauses": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution"
    ),
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mit-full": (
        "permission is hereby granted free of charge to any person obtaining a copy of this {{work:.+:1-6}} to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "[[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall {{holder:.+:1-8}} be liable for any claim damages or other liability whether "
        "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-full": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution "
        "[[[[3]] neither the name of {{owner:.+:1-8}} nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission]] "
        "this software is provided by {{giver:.+:1-8}} as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed"
    ),
    "apache-header-{v}": (
        "licensed under the apache license version {{v:[0-9]+:1-2}} the license you may not use this file except in compliance with the license you may obtain "
        "a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license"
    ),
    "gpl-header-{v}": (
        "{{work:.+:1-4}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as "
        "published by the free software foundation either version {{v:[0-9]+:1-2}} of the license or at your option any later version "
        "{{name:.+:1-4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details"
    ),
    "mpl-{v}": "this source code form is subject to the terms of the mozilla public license v {{v:[0-9]+:1-2}} if a copy of the mpl was not distributed with this file you can obtain one at",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
        "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions"
    ),
    "boost-{v}": "distributed under the boost software license version {{v:[0-9]+:1-2}}",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}

_MARK = re.compile(r"\[\[|\]\]|\{\{(\w+):(.*?):(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split(b" ") if text else []


@dataclass
class Automaton:
    """Non-deterministic automaton over words. ``steps[s]``: (matcher, region, next, mandatory); ``skips[s]``: free moves."""

    label: str
    steps: dict[int, list] = field(default_factory=lambda: defaultdict(list))
    skips: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    final: int = 0
    mandatory: int = 0
    starts: list = field(default_factory=list)


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    now, opened = 0, []
    fresh = iter(range(1, 1 << 30))
    for found in _MARK.finditer(template):
        token = found[0]
        if token == "[[":
            opened.append(now)
        elif token == "]]":
            a.skips[opened.pop()].append(now)
        elif found[1]:
            name, pattern, least, most = found[1], re.compile(found[2].encode()), int(found[3]), int(found[4])
            for k in range(most):
                nxt = next(fresh)
                a.steps[now].append((pattern, name, nxt, False))
                if k >= least:
                    a.skips[now].append(-1 - most)  # patched to the region's end below
                now = nxt
            end = now
            for skips in a.skips.values():
                skips[:] = [end if x == -1 - most else x for x in skips]
        else:
            nxt = next(fresh)
            a.steps[now].append((token.encode(), "", nxt, not opened))
            now = nxt
            a.mandatory += not opened
    a.final = now
    for s in _closure(a, [0]):
        a.starts += [m for m, *_ in a.steps[s]]
    return a


def _closure(a: Automaton, states) -> list[int]:
    seen, todo = [], list(states)
    while todo:
        s = todo.pop()
        if s not in seen:
            seen.append(s)
            todo += a.skips[s]
    return seen


def run_from(a: Automaton, words: list[bytes], at: int) -> tuple[int, int, dict[str, list[bytes]] | None]:
    """Run at one word: most mandatory words matched, end of the longest acceptance (or -1), its regions' words."""
    live: dict[int, tuple[int, dict]] = {s: (0, {}) for s in _closure(a, [0])}
    best, end, regions = 0, -1, None
    for k in range(at, len(words) + 1):
        if a.final in live and k > at:
            end, regions = k, live[a.final][1]
        if k == len(words) or not live:
            break
        nxt: dict[int, tuple[int, dict]] = {}
        for s, (n, got) in live.items():
            for match, name, t, must in a.steps[s]:
                if (match == words[k]) if isinstance(match, bytes) else match.fullmatch(words[k]):
                    to = (n + must, got if not name else {**got, name: [*got.get(name, []), words[k]]})
                    best = max(best, to[0])
                    for u in _closure(a, [t]):
                        if u not in nxt or nxt[u][0] < to[0]:
                            nxt[u] = to
        live = nxt
    return best, end, regions


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for k, a in enumerate(self.automata):
            for m in a.starts:
                if isinstance(m, bytes):
                    self.by_word[m].append(k)
        #: Templates that begin with a replaceable region start before their first fixed word: at most so many words.
        self.led = {k: self._lead(a) for k, a in enumerate(self.automata) if not all(isinstance(m, bytes) for m in a.starts)}
        for k, (word, _) in self.led.items():
            self.by_word[word].append(k)
        self.phrases = {b" " + k.encode() + b" ": (v, len(k.split())) for k, v in (PHRASES if phrases is None else phrases).items()}

    @staticmethod
    def _lead(a: Automaton) -> tuple[bytes, int]:
        """First fixed word after a leading region, and the most words of that region."""
        state, most = 0, 0
        while not isinstance(a.steps[state][0][0], bytes):
            state, most = a.steps[state][0][2], most + 1
        return a.steps[state][0][0], most

    def scan(self, text: str | None) -> dict:
        words = [w for w in words_of(text) if w]
        joined = b" " + b" ".join(words) + b" "
        spots, base, labels, score, spans = [], set(), set(), 0.0, []
        for phrase, (label, _) in self.phrases.items():
            at, word, counted = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)  # only from the last place on, so that time grows with the text
                counted = at
                spots.append(word)
                base.add(label)
                at = joined.find(phrase, at + 1)
        ends = [0] * len(self.automata)
        for at, w in enumerate(words):
            for k in self.by_word.get(w, ()):
                a = self.automata[k]
                for begin in range(max(ends[k], at - self.led[k][1]), at) if k in self.led else (at,):
                    if begin < ends[k]:
                        continue
                    n, end, regions = run_from(a, words, begin)
                    if end >= 0:
                        parts = {x: b"".join(b"-" + y for y in v) if x == "terms" else b".".join(v) for x, v in (regions or {}).items()}
                        labels.add(re.sub(r"\{(\w+)\}", lambda m, parts=parts: parts.get(m[1], b"").decode("utf-8", "replace"), a.label))
                        spans.append((begin, end))
                        ends[k] = end
                    score = max(score, 1.0 if end >= 0 else n / (a.mandatory + 1))
        return {
            "n_words": len(words), "n_base": len(spots), "first_word": min(spots, default=None), "last_word": max(spots, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score, "spans": spans,
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<begin:long,end:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: phrase places and labels, the labels of accepted templates, their word spans and a score.

    ``score`` is 1 if a template matches, its mandatory wording exactly, else the largest share of a template's mandatory
    words (and its end) that a run from one of its first words reaches. Null and empty texts have no word, null positions, empty labels
    and score 0; null ids pass through; repeated rows each appear; time grows with the text; an empty table gives an empty
    result; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    row = scanner.scan(text)
                    rows.append(row | {"doc_id": doc_id, "spans": [{"begin": b, "end": e} for b, e in row["spans"]]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, SCHEMA)
