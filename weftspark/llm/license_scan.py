"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A notice is a line, compared to the short TEMPLATES, or a block, compared to the whole licence texts, headers and titles in
the folder licenses. Blocks are paragraphs, runs of comment lines, the text from its first to its last paragraph that holds
one of the MARKERS, and the whole text. Licence files and headers are read alike. Vectors are sparse; document frequencies
are those of all files and templates, and words that no template has count with the largest idf, so foreign text lowers
the cosine. A notice takes the template of the highest cosine, if it is at least THRESHOLD (blocks: BLOCK_THRESHOLD); a
file takes its best notice (ties: smaller template name).

No line or block is left out: those of a text need no look only if its words, all together, hold too little of the weight
of every template for any cosine to reach its threshold.

A file without a licence of its own inherits that of the nearest directory above it in which a licence file (its base
name begins with LICENSE, LICENCE or COPYING) was recognised; of several there, the one with the smallest path.

Null or empty text has no notice. Null paths keep their own licence and inherit none. Rows that repeat a path are files
of their own. Of other columns only `row` is read, and given back with each row's result. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches

THRESHOLD = 0.5
#: Blocks are compared to whole licences, which share more of their common words with any prose.
BLOCK_THRESHOLD = 0.8
MARKERS = r"(?i)licen[sc]e|copyright|copyleft|spdx|public domain|all rights reserved|permission is hereby"
_MARKED = re.compile(MARKERS)
#: Up to so many directories with a licence file are broadcast; above, they are joined by shuffle.
BROADCAST_DIRS = 100_000
# The usual short notices of common licences, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms is permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: What stands before and after the text of a comment line.
COMMENT = re.compile(r"^[ \t]*(?:<!--|/\*+|\*+(?!/)|//+!?|#+|--+|;+|%+)[ \t]?")
COMMENT_END = re.compile(r"[ \t]*(?:\*+/|-->)[ \t]*$")


def license_texts() -> list[tuple[str, str]]:
    """SPDX name, text of the whole licences, headers and titles in the folder licenses; a bounded table.

    Headers count without their last paragraphs too, which are often left out or name another address.
    """
    found = []
    for file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        name, text = re.sub(r"(\.header|\.title)?\.txt$", "", file.name), file.read_text("utf-8")
        found.append((name, text))
        paragraphs = text.strip().split("\n\n")
        if file.name.endswith(".header.txt"):
            found += [(name, "\n\n".join(paragraphs[:n])) for n in range(1, len(paragraphs))]
    return found


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def document_frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """The number of files and templates, and in how many of them each word of the templates is. files: text."""
    of_templates = Counter(word for _, text in templates for word in set(words_of(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in (small for whole in batches for small in small_batches([whole], "text")):
            for text in batch.column(0):
                found.update(of_templates.keys() & set(words_of(text.as_py() or "")))
                found[""] += 1  # no word; counts the files
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "files"])

    counts = files.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, files bigint").groupBy("word").agg(F.sum("files"))
    of_files = dict(counts.collect())  # a row for each word of the templates
    return of_files.pop("", 0) + len(templates), {word: n + of_files.get(word, 0) for word, n in of_templates.items()}


class Vectors:
    """Unit TF-IDF vectors of templates (name, text), and the likeliest template of a text. damped: 1 + log of counts."""

    def __init__(self, templates: list[tuple[str, str]], damped: bool, threshold: float, n: int, frequencies: dict[str, int]):
        self.damped, self.threshold, self.names = damped, threshold, [name for name, _ in templates]
        counts = [Counter(words_of(text)) for _, text in templates]
        self.idf = {word: math.log((1 + n) / (1 + frequencies[word])) + 1 for c in counts for word in c}
        self.rare = max(self.idf.values()) + 0.5
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            weights = self._weights(c)
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for word, w in weights.items():
                self.postings.setdefault(word, []).append((i, w / norm))
        self.place = {word: k for k, word in enumerate(self.postings)}
        self.squares = np.zeros((len(self.postings), len(templates)))
        for word, k in self.place.items():
            for i, w in self.postings[word]:
                self.squares[k, i] = w * w

    def _weights(self, counts: Counter) -> dict[str, float]:
        return {word: (1 + math.log(n) if self.damped else n) * self.idf.get(word, self.rare) for word, n in counts.items()}

    def reachable(self, words: set[str]) -> bool:
        """Whether a text of these words can have a cosine of at least the threshold: it is at most the length of the part of a template that they hold."""
        places = [self.place[word] for word in self.place.keys() & words]
        return bool(self.squares[places].sum(axis=0).max(initial=0) >= self.threshold**2 - 1e-9)

    def best(self, text: str) -> tuple[float, str] | None:
        """Minus similarity and name of the template, the smallest such pair."""
        counts = Counter(words_of(text))
        if not self.reachable(set(counts)):
            return None
        weights = self._weights(counts)
        squares = sum(w * w for w in weights.values())
        dots = [0.0] * len(self.names)
        for word, w in weights.items():
            for i, of_template in self.postings.get(word, ()):
                dots[i] += w * of_template
        found = [(-round(d / math.sqrt(squares), 9), self.names[i]) for i, d in enumerate(dots) if d]
        return min((f for f in found if -f[0] >= self.threshold), default=None)


def blocks(text: str) -> set[str]:
    """The blocks of a text, without comment signs: paragraphs, runs of comment lines, from the first to the last paragraph with a marker, the whole."""
    found, comment, paragraph, paragraphs = set(), [], [], []
    lines = re.split(r"\r?\n|\r", text)
    for line in [*lines, ""]:
        bare = COMMENT_END.sub("", COMMENT.sub("", line))
        if bare.strip():
            paragraph.append(bare)
        elif paragraph:
            paragraphs.append("\n".join(paragraph))
            paragraph = []
        if COMMENT.match(line):
            comment.append(bare)
        elif comment:
            found.add("\n".join(comment))
            comment = []
    if comment:
        found.add("\n".join(comment))
    places = [i for i, p in enumerate(paragraphs) if _MARKED.search(p)]
    if places:
        found.add("\n\n".join(paragraphs[places[0] : places[-1] + 1]))
    return found | set(paragraphs) | {"\n\n".join(paragraphs)}


def own_license(text: Column, templates: dict[str, str], threshold: float, n: int, frequencies: dict[str, int]) -> Column:
    """license, similarity of the best notice line or block of a text, or null. n, frequencies: of document_frequencies()."""
    short = Vectors(list(templates.items()), False, threshold, n, frequencies)
    long = Vectors(license_texts(), True, BLOCK_THRESHOLD, n, frequencies)

    def of_text(value: str) -> tuple[str, float] | None:
        words, found = set(words_of(value)), []
        if short.reachable(words):
            found += [short.best(line) for line in set(re.split(r"\r?\n|\r", value))]
        if long.reachable(words):
            found += [long.best(block) for block in blocks(value)]
        best = min((f for f in found if f), default=None)
        return best and (best[1], -best[0])

    @F.pandas_udf("license string, similarity double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t and of_text(t)) or (None, None) for t in texts], columns=["license", "similarity"])

    return scored(text)


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, similarity, license_from (own, inherited, none), license_path of each row. files: path, text, and row if it is to be carried along."""
    carried, templates = ["row"] if "row" in files.columns else [], templates or TEMPLATES
    n, frequencies = document_frequencies(files, [*templates.items(), *license_texts()])
    own = own_license(F.col("text").cast("string"), templates, threshold, n, frequencies)
    found = files.select(F.col("path").cast("string").alias("path"), own.alias("own"), *carried)
    marked = kept(found.select("path", "own.license", "own.similarity", *carried), "own-licences")
    directory = F.regexp_replace("path", r"[^/]*$", "")
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying)")
    licensed = marked.where(is_file & F.col("license").isNotNull()).groupBy(directory.alias("dir"))
    of_file = F.struct(F.col("license").alias("dir_license"), F.col("path").alias("license_path"))
    dirs = kept(licensed.agg(F.min_by(of_file, F.struct("path", "license")).alias("found")).select("dir", "found.*"), "licence-dirs")
    few = dirs.count() <= BROADCAST_DIRS
    without = marked.where("license is null and path is not null").select("path").distinct()
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    steps = without.select("path", F.explode(above).alias("dir"))
    nearest = steps.join(F.broadcast(dirs) if few else dirs, "dir").groupBy("path").agg(F.max_by(F.struct("dir_license", "license_path"), F.length("dir")).alias("near"))
    nearest = nearest.select(F.col("path").alias("heir"), "near.*")
    heir = (F.col("path") == F.col("heir")) & F.col("license").isNull()
    own_one = F.col("license").isNotNull()
    kind = F.when(own_one, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    columns = [F.coalesce("license", "dir_license").alias("license"), "similarity", kind.alias("license_from")]
    return marked.join(nearest, heir, "left").select(*carried, "path", *columns, F.when(own_one, F.col("path")).otherwise(F.col("license_path")).alias("license_path"))
