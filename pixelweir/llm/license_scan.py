"""Licence scan with a positional index of rare words.

Templates are word sequences. The index lists, for each of their words, the templates and positions it stands at. How
rare a word is comes from all documents: one pass counts the documents that hold each licence word. A phrase's anchor is its
rarest word, so each place of a phrase shows up at an occurrence of its anchor; a text template is
found from its rarest words together, at each relative position (place in the file minus place in the template) on which, or near
which, half of them agree.
Every candidate is then verified: a phrase word by word, a text template by its coverage and its mandatory key phrases.

Defined results: a null or empty text has no words, no labels and score 0; a very long text is scanned whole by one task, with memory in proportion to its
words; of places of one template that stand nearer than half its size the one with most anchors counts, then the one with most
neighbours, then the first; rows that repeat are scanned alike and never merged; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, per_row, text_bytes

#: Word characters are digits, letters and all beyond ASCII; A-Z fold to a-z, everything else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Phrases that carry a label of the method's own.
NOTICES = (
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("bsd 3 clause license", "bsd-3"),
    ("bsd 2 clause license", "bsd-2"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)

#: Licence texts: label, words, and key phrases that must stand within the match. Fixed values from the public licences.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2", "except in compliance with the license")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("redistribution and use in source and binary forms", "endorse or promote products")),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "endorse or promote products")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2", "except in compliance with the license", "on an as is basis")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", ("gnu lesser general public license", "at your option any later version")),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details", ("gnu affero general public license", "at your option any later version")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("with or without fee is hereby granted", "the author disclaims all warranties")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("including commercial applications", "the origin of this software must not be misrepresented")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software", "released into the public domain")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", ("any person or organization obtaining a copy", "prepare derivative works of the software")),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial international license", ("creative commons attribution noncommercial",)),
)

COVERAGE = 0.6
ANCHORS = 8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    base: bool = False
    whole: bool = True  # a phrase, word by word
    keys: list[list[bytes]] = field(default_factory=list)


def templates() -> list[Template]:
    split = lambda x: x.encode().split()
    return [
        *(Template(label, split(phrase), base=True) for phrase, label in BASE),
        *(Template(label, split(phrase)) for phrase, label in NOTICES),
        *(Template(label, split(text), whole=False, keys=[split(k) for k in keys]) for label, text, keys in TEXTS),
    ]


def stands_at(phrase: list[bytes], words: list[bytes], at: int) -> bool:
    return at >= 0 and words[at : at + len(phrase)] == phrase


class PositionalIndex:
    """Postings of the templates' words, the rarest words as anchors."""

    def __init__(self, found: list[Template], idf: dict[bytes, float]):
        self.templates, self.idf = found, idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: set[bytes] = set()
        self.of: list[set[bytes]] = []
        for t, template in enumerate(found):
            for at, word in enumerate(template.words):
                self.postings[word].append((t, at))
            ordered = sorted(set(template.words), key=lambda w: (-idf.get(w, 0.0), w))
            chosen = set(ordered[: 1 if template.whole else ANCHORS])
            self.of.append(chosen)
            self.anchors |= chosen

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, float]]]:
        """The number of words, and the matches: template, first word, end, share of the template's words in place."""
        words = words_of(text)
        if self.anchors.isdisjoint(words):
            return len(words), []
        votes: dict[tuple[int, int], list[int]] = defaultdict(list)
        phrases = []
        for at, word in enumerate(words):
            if word in self.anchors:
                for t, inside in self.postings[word]:
                    if word in self.of[t]:
                        template = self.templates[t]
                        if not template.whole:
                            votes[t, at - inside].append(inside)
                        elif stands_at(template.words, words, at - inside):
                            phrases.append((t, at - inside))
        out = [(t, at, at + len(self.templates[t].words), 1.0) for t, at in sorted(set(phrases))]
        by_template: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for (t, shift), inside in sorted(votes.items()):
            by_template[t][shift] = inside
        for t, shifts in by_template.items():
            out += self.places(t, shifts, words)
        return len(words), out

    def places(self, t: int, shifts: dict[int, list[int]], words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """All verified places of a text template, from the anchors (positions in it) that vote for each shift, in rising order.

        Shifts within a quarter of the template's size vote together, for the one that has most of them, as words may be added or missing in between. Of
        verified places nearer than half its size the one with most votes counts.
        """
        size = len(self.templates[t].words)
        order, least = list(shifts), max(2, len(self.of[t]) // 2)
        together: Counter[int] = Counter()
        candidates: dict[int, int] = {}
        end = 0
        for start, low in enumerate(order):
            while end < len(order) and order[end] <= low + size // 4:
                together.update(shifts[order[end]])
                end += 1
            if len(together) >= least:
                best = max(order[start:end], key=lambda s: len(shifts[s]))
                candidates[best] = max(candidates.get(best, 0), len(together))
            for inside in shifts[low]:
                together[inside] -= 1
                if not together[inside]:
                    del together[inside]
        found: dict[int, tuple[int, int, int, float]] = {}
        for shift in sorted(candidates, key=lambda s: (-len(shifts[s]), -candidates[s], s)):
            if not any(s in found for s in range(shift - size // 2 + 1, shift + size // 2)):
                for place in self.verified(t, shift, words):
                    found[shift] = place
        return [found[s] for s in sorted(found)]

    def verified(self, t: int, shift: int, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """A text template at a relative position, if enough of it and all its key phrases are there; words may be added or missing."""
        template = self.templates[t]
        size = len(template.words)
        lo, hi = max(0, shift - size // 4), min(len(words), shift + size + size // 4)
        window = words[lo:hi]
        have, need = Counter(window), Counter(template.words)
        coverage = sum(min(n, have[w]) for w, n in need.items()) / size
        if coverage < COVERAGE or not all(any(stands_at(key, window, k) for k, w in enumerate(window) if w == key[0]) for key in template.keys):
            return []
        return [(t, max(shift, lo), hi, coverage)]


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and for each licence word the number that holds it; counted over all documents."""
    vocabulary = frozenset(w for x in templates() for w in x.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            n[b""] += batch.num_rows
            for text in text_bytes(batch.column("text")):
                n.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


def build_index(docs: DataFrame) -> PositionalIndex:
    total, holds = document_frequencies(docs)
    every = {w for x in templates() for w in x.words}
    return PositionalIndex(templates(), {w: math.log((1 + total) / (1 + holds.get(w, 0))) for w in every})


def matches(docs: DataFrame, index: PositionalIndex | None = None) -> DataFrame:
    """doc_id, label, first_word, end_word and coverage of every match in every document."""
    index = index or build_index(docs)
    kind = "found array<struct<label:string,first_word:bigint,end_word:bigint,coverage:double>>"
    arrow = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))

    def work(given: dict[str, list]) -> dict[str, list]:
        found = [[{"label": index.templates[t].label, "first_word": a, "end_word": b, "coverage": c} for t, a, b, c in index.scan(x)[1]] for x in given["text"]]
        return {"found": pa.array(found, arrow)}

    return per_row(docs, ["doc_id", "text"], kind, work).select("doc_id", F.inline("found"))


def _digest(index: PositionalIndex, text: bytes) -> tuple:
    n_words, found = index.scan(text)
    base = [(at, index.templates[t].label) for t, at, _, _ in found if index.templates[t].base]
    starts = [at for at, _ in base]
    join = lambda labels: ",".join(sorted(set(labels)))
    return (n_words, len(base), min(starts, default=None), max(starts, default=None), join(x for _, x in base), join(index.templates[t].label for t, *_ in found), max((c for *_, c in found), default=0.0))


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, index: PositionalIndex | None = None) -> DataFrame:
    """doc_id, word and phrase counts, labels and score (the best match's coverage) of every document."""
    index = index or build_index(docs)
    names = [x.strip().split(" ")[0] for x in COLUMNS.split(",")]

    def work(given: dict[str, list]) -> dict[str, list]:
        rows = [_digest(index, x) for x in given["text"]]
        return {c: [r[k] for r in rows] for k, c in enumerate(names)}

    return per_row(docs, ["doc_id", "text"], COLUMNS, work).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
