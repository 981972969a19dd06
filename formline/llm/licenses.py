"""Licence scans by the places of licence words.

The index holds passages of public licences: notices, titles, and the sentences of licence texts, each a
template of its own, so that an edit or a cut costs the passage it meets and no other. The inverse
document frequency of every template word is counted over all documents. An alignment of
a template puts its word q at place q + shift of the file, and covers the idf of the words that stand
there. For every template whose words in the file could cover the share ``COVERED``, the words that
the file holds least often propose shifts p - q, as many words as it takes that the others fall short
of the share: so every alignment that covers it is proposed, however many notices a file holds.
Proposed alignments are checked word by word, and a template's label is given only if one of its
mandatory key phrases stands in the file where the alignment puts it. The score is the best share of a
template's idf that an accepted alignment covers.

Null and empty texts have no words, no places and empty labels. Ties between templates give both
labels. Rows are scanned one by one; repeated rows agree. A very long text is scanned whole, by one task:
its words are read once, and alignments are checked only where rare words propose them. An empty table
gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)

# The phrases that the base labels stand for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of public licences, with the phrases of which one must be met.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT license", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge"]),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["deal in the software without restriction"]),
    ("mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["persons to whom the software is furnished"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ["copies or substantial portions"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004", ["apache license version 2 0"]),
    ("apache-2.0", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", ["publicly perform sublicense and distribute the work"]),
    ("apache-2.0", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form", ["copies of the work or derivative works thereof"]),
    ("apache-2.0", "You must cause any modified files to carry prominent notices stating that You changed the files", ["prominent notices stating that you changed the files"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ["version 2 june 1991"]),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it", ["designed to take away your freedom to share and change it"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["general public license version 3 29 june 2007"]),
    ("gpl-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works", ["most software and other practical works"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program", ["gnu general public license along with"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library", ["gnu lesser general public license along with"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ["affero general public license version 3"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from"]),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", ["provided by the copyright holders and contributors as is"]),
    ("bsd", "Released under the BSD License", ["bsd license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", ["the author disclaims all warranties with regard to this software"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["alter it and redistribute it freely"]),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", ["origin of this software must not be misrepresented"]),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    ("bsl-1.0", "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ["distribute execute and transmit the software"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["mozilla org mpl 2 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0", "eclipse public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", ["anyone is free to copy modify publish"]),
    ("cc0", "Creative Commons CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("reserved", "All rights reserved", ["all rights reserved"]),
]

#: Share of a template's idf that an alignment must cover.
COVERED = 0.6
#: Sums in another order may differ by this much; they only propose.
SLACK = 1e-9


def split(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


class Index:
    """Templates by word, with the idf of their words."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], idf: dict[str, float]):
        self.idf = idf
        self.labels = [t[0] for t in templates]
        self.words = [split(t[1]) for t in templates]
        self.keys = [[p.split() for p in t[2]] for t in templates]
        self.weight = [sum(idf[w] for w in ws) for ws in self.words]
        self.base = [(p.split(), label) for p, label in BASE.items()]
        #: By word: the templates that hold it and what it adds to their covered idf.
        self.adds: dict[str, list[tuple[int, float]]] = {}
        for t, ws in enumerate(self.words):
            for w, n in Counter(ws).items():
                self.adds.setdefault(w, []).append((t, idf[w] * n))
        self.heads = frozenset({p[0] for p, _ in self.base} | set(self.adds))

    def shifts(self, t: int, at: dict[str, list[int]]) -> set[int]:
        """Where template t may be aligned; among them every alignment that covers the share."""
        left_out, out = 0.0, set()
        for q, w in sorted(enumerate(self.words[t]), key=lambda x: -len(at.get(x[1], ()))):
            if left_out + self.idf[w] < COVERED * self.weight[t] - SLACK:
                left_out += self.idf[w]
            else:
                out.update(p - q for p in at.get(w, ()))
        return out

    def scan(self, words: list[str]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """Base places, the first and last of them, base labels, all labels, score."""
        heads = self.heads
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in heads:
                at.setdefault(w, []).append(i)
        places, base = [], set()
        for phrase, label in self.base:
            n = len(phrase)
            for i in at.get(phrase[0], ()):
                if words[i : i + n] == phrase:
                    places.append(i)
                    base.add(label)
        labels, best = set(base), 0.0
        # A template whose words in this file, wherever they stand, fall short of the share has no alignment.
        bound: Counter[int] = Counter()
        for w in at:
            for t, x in self.adds.get(w, ()):
                bound[t] += x
        open_ = [t for t, x in bound.items() if x >= COVERED * self.weight[t] - SLACK]
        for t, shift in ((t, shift) for t in open_ for shift in self.shifts(t, at)):
            got = sum(self.idf[w] for q, w in enumerate(self.words[t]) if 0 <= q + shift < len(words) and words[q + shift] == w)
            share = got / self.weight[t] if self.weight[t] else 0.0
            if share < COVERED or self.labels[t] in labels and share <= best:
                continue
            span = words[max(0, shift) : max(0, shift) + len(self.words[t]) + 4]
            if any(span[i : i + len(k)] == k for k in self.keys[t] for i in range(len(span) - len(k) + 1)):
                labels.add(self.labels[t])
                best = max(best, share)
        if base:
            best = max(best, COVERED)
        return len(places), min(places, default=None), max(places, default=None), base, labels, best


def document_frequency(docs: DataFrame, templates=None) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each template word; at most as many rows as the templates have words."""
    vocab = sorted({w for t in templates or TEMPLATES for w in split(t[1])})
    words = F.split(F.translate("text", ascii_uppercase, ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = docs.where("text is not null").select(F.explode(F.array_intersect(words, F.array(*[F.lit(w) for w in vocab]))).alias("word"))
    found = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return docs.count(), {w: found.get(w, 0) for w in vocab}


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """Labels, places and score of every whole text."""
    templates = templates or TEMPLATES
    total, df = document_frequency(docs, templates)
    index = Index(templates, {w: math.log((1 + total) / (1 + n)) + 0.05 for w, n in df.items()})
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = held.value
        for pdf in bounded(batches):
            rows = []
            for text in pdf["text"]:
                words = split(text)
                n, first, last, base, labels, score = ix.scan(words)
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
