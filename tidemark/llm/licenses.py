"""Licence scans by a positional rare-token index.

Templates (short phrases, and longer passages with mandatory key phrases) are indexed by word and position.
Document frequencies of the templates' words are counted over all documents. A file's licence words are looked
up from the rarest on; each occurrence at position p that a template has at position q votes for the template
at p - q. A short phrase is anchored on its rarest word and verified word by word, so every place is found. A
passage needs votes from enough of its rare words at one relative position, give or take a few words, and then
its mandatory phrases, word by word, within its extent; of five words of such a phrase one may be another. Names, tags and
addresses of licences are found like base phrases, but add method labels alone. Templates are whole notices, their first
sentences by themselves, and the names.

Words: A-Z is lower-cased, then maximal runs of digits, a-z and non-ASCII characters. Null texts are empty. A
null doc_id is carried. Repeated rows get equal results. Empty table: empty result. Extra columns are unread.
Texts are whole. Words of equal frequency are taken in alphabetical order.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that name a licence wherever they stand, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of well-known licences, with a label and the phrases that must be there.
PASSAGES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ["apache license version 2 0"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["gnu general public license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ["gnu affero general public license"],
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ["creative commons attribution sharealike"],
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    (
        "cc0",
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights",
        ["cc0", "waived all copyright"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        ["eclipse public license"],
    ),
]

# Whole notices as they are put into files, with a label and the phrases that must be there.
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
)
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        f"subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}",
        ["to any person obtaining a copy of this software", "without restriction"],
    ),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    (
        "bsd-3-clause",
        f"{_BSD_CONDITIONS} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_WARRANTY}",
        ["neither the name of", "may be used to endorse or promote products derived from this software"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ["for any purpose with or without fee"],
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["unless required by applicable law or agreed to in writing"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ["you should have received a copy of the gnu general public license"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        ["released into the public domain"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        ["the origin of this software must not be misrepresented"],
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ["any person or organization obtaining a copy"],
    ),
]

# Names, tags and addresses that name a licence wherever they stand. Unlike base phrases they are no base labels.
SPDX = {
    "mit": "mit",
    "apache 2 0": "apache",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl",
    "mpl 2 0": "mpl",
    "epl 2 0": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc": "isc",
    "zlib": "zlib",
    "bsl 1 0": "bsl-1.0",
    "unlicense": "unlicense",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
}
NAMES = {f"spdx license identifier {tag}": label for tag, label in SPDX.items()} | {
    "bsd 3 clause license": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0": "cc-by",
    "apache org licenses license 2 0": "apache",
    "opensource org licenses mit": "mit",
    "gnu org licenses gpl": "gpl",
    "gnu org licenses lgpl": "lgpl",
    "gnu org licenses agpl": "agpl",
    "mozilla org mpl 2 0": "mpl",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by 4 0": "cc-by",
    "creativecommons org publicdomain zero 1 0": "cc0",
}

#: Rare words of a passage that are looked up (and one for so many words of a longer one), the share of them that must
#: agree, the slack of their position (and one for so many words), and words of a mandatory phrase for one that may differ.
RARE, RARE_EVERY, AGREE, SLACK, SLACK_EVERY, WORDS_A_SLIP = 8, 6, 0.6, 3, 20, 5

_TABLE = bytearray(b" " * 256)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _TABLE[_b] = _b
_TABLE = bytes(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def stands_in(phrase: list[bytes], words: list[bytes]) -> bool:
    """Whether a phrase stands in consecutive words; of five words of it one may be another."""
    n, slips = len(phrase), len(phrase) // WORDS_A_SLIP
    return any(sum(map(ne, phrase, words[p : p + n])) <= slips for p in range(len(words) - n + 1))


class Index:
    """Templates by rare word and position, given how many documents hold each word."""

    def __init__(self, frequency: dict[bytes, int]):
        self.n = frequency.get(b"", 0)
        self.frequency = frequency
        self.phrases = [(words_of(p), label) for p, label in [*PHRASES.items(), *NAMES.items()]]
        self.passages = [(label, words_of(t), [words_of(p) for p in phrases]) for label, t, phrases in [*PASSAGES, *NOTICES]]
        #: word: (phrase, position in it), for each phrase's rarest word.
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (words, _) in enumerate(self.phrases):
            rare = min(words, key=lambda w: (frequency.get(w, 0), w))
            self.anchors[rare].append((k, words.index(rare)))
        #: word: (passage, position in it), for each passage's rarest words.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weight: list[float] = []
        for k, (_, words, _) in enumerate(self.passages):
            rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[: max(RARE, len(words) // RARE_EVERY)]
            self.weight.append(sum(self.idf(w) for w in rare))
            for w in rare:
                self.postings[w] += [(k, q) for q, x in enumerate(words) if x == w]
        self.words = frozenset(self.anchors) | frozenset(self.postings)

    def idf(self, word: bytes) -> float:
        return math.log((self.n + 1) / (self.frequency.get(word, 0) + 1)) + 1

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str], list[str], float]:
        """Starts of all base phrases, base labels, all labels, and a score from 0 to 1."""
        present = self.words.intersection(words)
        if not present:
            return [], [], [], 0.0
        starts, base, named, votes = [], set(), set(), defaultdict(Counter)
        rarest = sorted(present, key=lambda w: (self.frequency.get(w, 0), w))
        at: dict[bytes, list[int]] = {w: [] for w in rarest}
        for p, w in enumerate(words):
            if w in at:
                at[w].append(p)
        for w in rarest:
            for k, q in self.anchors.get(w, ()):
                phrase, label = self.phrases[k]
                # The anchor may stand more than once in a phrase; its first position fixes the start.
                found = [p - q for p in at[w] if p >= q and words[p - q : p - q + len(phrase)] == phrase]
                if found and k >= len(PHRASES):
                    named.add(label)
                elif found:
                    starts += found
                    base.add(label)
            for k, q in self.postings.get(w, ()):
                for p in at[w]:
                    votes[k][p - q, w] = 1
        labels, score = base | named, 1.0 if base or named else 0.0
        for k, cast in votes.items():
            label, template, mandatory = self.passages[k]
            slack = SLACK + len(template) // SLACK_EVERY
            by_place: dict[int, set[bytes]] = defaultdict(set)
            for (place, w), _ in cast.items():
                by_place[place].add(w)
            best = 0.0
            for place in sorted(by_place):
                near = {w for d in range(-slack, slack + 1) for w in by_place.get(place + d, ())}
                share = sum(self.idf(w) for w in near) / self.weight[k]
                if share >= AGREE:
                    extent = words[max(0, place - slack) : max(0, place + len(template) + slack)]
                    if all(stands_in(m, extent) for m in mandatory):
                        labels.add(label)
                        best = max(best, share)
                        continue
                best = max(best, share / 2)
            score = max(score, min(best, 1.0))
        return sorted(starts), sorted(base), sorted(labels), score


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = {w for t in [*PHRASES, *NAMES, *(t for _, t, _ in [*PASSAGES, *NOTICES])] for w in words_of(t)}
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(vocabulary.intersection(words_of(text)))
            seen[b""] += 1
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def build_index(docs: DataFrame) -> Index:
    """Counts the templates' words over all documents; their number is fixed by the templates."""
    counted = docs.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Index({r["word"].encode(): r["n"] for r in counted.collect()})


def scan_licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = build_index(docs) if index is None else index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                starts, base, labels, score = index.scan(words)
                row = (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(labels), score)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
