"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a file is a possible header and the whole file a possible licence file; both are compared with the
templates as sparse TF-IDF vectors. Document frequencies of template terms are counted over all files; a term that no
template holds weighs as the rarest. By Cauchy-Schwarz a line without any of the heaviest template terms cannot reach the threshold, so only lines that hold
one are scored.

A licence file speaks for its directory. Directories are few against files, so inheritance is resolved on distinct
directories: each is exploded into its ancestors, joined with the directories that have a licence by path, and takes
the deepest; files then join their directory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches, written

THRESHOLD = 0.7
#: Fixed values: (licence, notice). Public notices and their usual short forms.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() or b == 10 else (46 if b == 46 else 32) for b in range(256)).lower()


def terms(line: bytes) -> list[bytes]:
    """Words of a translated line, without dots at their ends."""
    return [w for w in (x.strip(b".") for x in line.split()) if w]


def translated(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED)


class Scorer:
    """Templates weighted by document frequencies."""

    def __init__(self, documents: int, frequency: dict[bytes, int], threshold: float) -> None:
        rare = math.log(1 + documents) + 1
        self.idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary()}
        self.rare = rare
        self.vectors: list[tuple[str, dict[bytes, float]]] = []
        for name, notice in TEMPLATES:
            v = {t: n * self.idf[t] for t, n in Counter(terms(translated(notice))).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {t: x / norm for t, x in v.items()}))
        # the heaviest terms, until what is left of every template is too short for the threshold
        self.needed: set[bytes] = set()
        for _, v in self.vectors:
            left = sum(x * x for x in v.values())
            for t, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if left < (threshold * 0.999) ** 2:
                    break
                self.needed.add(t)
                left -= x * x

    def best(self, words: list[bytes]) -> tuple[float, int]:
        """(cosine, template) of the closest template, the first of equals."""
        counts = Counter(words)
        norm = math.sqrt(sum((n * self.idf.get(t, self.rare)) ** 2 for t, n in counts.items()))
        scores = [sum(x * counts[t] * self.idf[t] for t, x in v.items() if t in counts) / norm for _, v in self.vectors]
        top = max(scores)
        return top, scores.index(top)


def vocabulary() -> set[bytes]:
    return {t for _, notice in TEMPLATES for t in terms(translated(notice))}


def document_frequencies(files: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Files, and how many of them hold each template term (as many rows as terms reach the driver); files: text."""
    known = vocabulary()
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                seen.update(known.intersection(terms(translated(text))))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    found = {r.term.encode(): r.n for r in files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def scan_licenses(files: DataFrame, file_id: str = "doc_id", text: str = "text", path: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, license, evidence, score, directory) for every row.

    evidence: 'file' (the whole text is a licence), 'header' (a line of it is a notice), 'inherited' (the nearest
    ancestor directory, its own included, holds a licence file; `directory` names it and score is that file's), or null without a licence. Of
    several headers the closest to a template counts; of several licence files in a directory the closest, then the
    smallest id. Null and empty texts have no header; a null path is in the root directory; repeated rows give a row
    each; an empty table gives none. Other columns are not read.
    """
    small_batches(files.sparkSession)
    rows = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    total, frequency = document_frequencies(rows)
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("license", pa.string()), ("evidence", pa.string()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(total, frequency, threshold)
        for batch in batches:
            names, kinds, scores = [], [], []
            for x in batch.column(1).to_pylist():
                whole = translated(x)
                found: tuple[float, int, str] | None = None
                lines = [w for w in (terms(line) for line in whole.split(b"\n")) if not scorer.needed.isdisjoint(w)]
                if lines:
                    score, at = scorer.best(terms(whole))
                    if score >= threshold:
                        found = (score, at, "file")
                    else:
                        score, at = max((scorer.best(w) for w in lines), key=lambda s: (s[0], -s[1]))
                        if score >= threshold:
                            found = (score, at, "header")
                names.append(TEMPLATES[found[1]][0] if found else None)
                kinds.append(found[2] if found else None)
                scores.append(round(found[0], 6) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    own = written(rows.mapInArrow(scan, "file_id long, path string, license string, evidence string, score double"), "licenses")
    own = own.withColumn("directory", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")))
    holders = own.where("evidence = 'file'").groupBy("directory").agg(F.max_by(F.struct("license", "score"), F.struct("score", -F.coalesce("file_id", F.lit((1 << 63) - 1)))).alias("held"))
    holders = holders.select(F.col("directory").alias("ancestor"), "held")
    parts = F.split("directory", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    chains = own.select("directory").distinct().select("directory", F.posexplode(F.array_distinct(up)).alias("depth", "ancestor"))
    nearest = chains.join(holders, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "held"), "depth").alias("from"))
    out = own.join(nearest, "directory", "left")
    return out.select(
        "file_id", "path", F.coalesce("license", "from.held.license").alias("license"), F.coalesce("evidence", F.when(F.col("from").isNotNull(), F.lit("inherited"))).alias("evidence"),
        F.coalesce("score", "from.held.score").alias("score"), F.when(F.col("license").isNull(), F.col("from.ancestor")).alias("directory"),
    )
