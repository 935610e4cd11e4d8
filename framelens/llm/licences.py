"""License scans: sparse TF-IDF cosine to templates, then inheritance along the directory tree.

Every line, every blank-line separated paragraph and the whole text of a file is a unit. Tokens are lower-case runs of ASCII
letters and digits; a token's weight is its count times ln((1 + N) / (1 + df)) + 1 over the N templates. A unit
matches the template of highest cosine if that is at least ``least``. Most units are passed over exactly: to
reach ``least`` with a template a unit must hold one of the template's heaviest tokens, those without which the
rest of the template's norm falls short (prefix filtering).

Three sets of templates are weighed apart, each against its own kind of unit: short notices (``TEMPLATES``) against all units,
standard headers (``HEADERS``) against runs of lines that hold letters or digits, so comment marks do not join paragraphs, and
licence texts (``licence_texts``) against whole files. A line with an SPDX identifier names its license itself.
A file that is a licence text as a whole has that license, unless a title or header in it is nearer; else the highest similarity counts.

A licence file gives its licence to its directory. A file without a licence of its own inherits that of its nearest ancestor
directory that has one: the distinct directories, not the files, are expanded to their ancestors and joined by
path. Several licence files in a directory: the highest similarity counts, then the smallest path.

Edge cases. Null and empty texts match nothing and may inherit. A null path has no directory: such rows keep
their own licence only. Repeated rows keep their rows. Templates without tokens match nothing. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import attach, bounded_batches, cut
from framelens.llm.licence_texts import TEXTS

#: License notices by SPDX id, in short and longer wordings (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: The granting paragraphs of the standard headers, and the titles of licence texts (fixed values).
HEADERS = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    *((name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {which} as published by "
             f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, what, which, version in (
          ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
          ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
          ("AGPL-3.0", "program", "Affero General Public License", "3"))),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 "
                "as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
)
FILES = tuple((name, Counter({t: int(n or 1) for t, _, n in (x.partition(":") for x in counts.split())})) for name, counts in TEXTS.items())
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)", re.ASCII)
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[A-Za-z0-9]")
_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_LOWER))


class Matcher:
    """The templates as unit vectors, and the tokens one of which every match holds."""

    def __init__(self, templates: tuple[tuple[str, str | Counter], ...] = TEMPLATES, least: float = 0.8, alone: bool = False):
        self.least = least
        self.headers, self.files = (None, None) if alone else (Matcher(HEADERS, least, True), Matcher(FILES, least, True))
        counts = [(name, text if isinstance(text, Counter) else Counter(tokens(text))) for name, text in templates]
        counts = [x for x in counts if x[1]]
        df = Counter(t for _, c in counts for t in c)
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.unseen = math.log(1 + len(counts)) + 1
        self.vectors, needed = [], set()
        for name, c in counts:
            w = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.vectors.append((name, {t: x / norm for t, x in w.items()}))
            left = 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                if math.sqrt(max(left, 0.0)) < least - 1e-9:
                    break
                needed.add(t)
                left -= (x / norm) ** 2
        self.holders: dict[str, list[tuple[int, float]]] = {}
        for k, (_, v) in enumerate(self.vectors):
            for t, x in v.items():
                self.holders.setdefault(t, []).append((k, x))
        self.needed = needed
        either = "|".join(sorted(needed)) or "(?!)"
        self.hint = re.compile(rf"(?<![a-z0-9])(?:{either})(?![a-z0-9])", re.ASCII | re.IGNORECASE)

    def best(self, unit: str) -> tuple[float, str] | None:
        """(similarity, license) of the nearest template, if it is near enough."""
        return self.nearest(Counter(tokens(unit)))

    def nearest(self, c: Counter) -> tuple[float, str] | None:
        w = {t: n * self.idf.get(t, self.unseen) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        # no cosine exceeds the share of the unit's norm that lies on known tokens
        if math.sqrt(sum(x * x for t, x in w.items() if t in self.holders)) < (self.least - 1e-9) * norm:
            return None
        dots = [0.0] * len(self.vectors)
        for t, y in w.items():
            for k, x in self.holders.get(t, ()):
                dots[k] += x * y
        found = max(((d / norm, name) for d, (name, _) in zip(dots, self.vectors, strict=True)), default=None) if norm else None
        return found if found and found[0] >= self.least else None

    def scan(self, text: str | None) -> tuple[str, float, int] | None:
        """(license, similarity, line) of the best unit, the first of equals."""
        text = text or ""
        seen = Counter(tokens(text))
        if self.files and (b := self.files.nearest(seen)):
            title = self.headers.paragraphs(text)  # of a version whose text is no template
            return title if title and title[1] > round(b[0], 9) else (b[1], round(b[0], 9), 0)
        found = [x for x in (None if self.needed.isdisjoint(seen) else self._units(text),
                             None if not self.headers or self.headers.needed.isdisjoint(seen) else self.headers.paragraphs(text),
                             spdx(text) if "spdx" in seen else None) if x]
        return max(found, key=lambda x: (x[1], -x[2])) if found else None

    def paragraphs(self, text: str) -> tuple[str, float, int] | None:
        """The best run of lines that hold letters or digits."""
        if not self.hint.search(text):
            return None
        found, first, block = [], 0, []
        for k, x in enumerate([*text.split("\n"), ""]):
            if _WORD.search(x):
                block.append(x)
                continue
            if block and self.hint.search(whole := "\n".join(block)) and (b := self.best(whole)):
                found.append((round(b[0], 9), -first, b[1]))
            first, block = k + 1, []
        if not found:
            return None
        similarity, line, name = max(found)
        return name, similarity, -line

    def _units(self, text: str) -> tuple[str, float, int] | None:
        if not self.hint.search(text):
            return None
        lines = text.split("\n")
        units = [(k, x) for k, x in enumerate(lines) if self.hint.search(x)]
        first, block = 0, []
        for k, x in enumerate([*lines, ""]):
            if x.strip():
                block.append(x)
                continue
            if len(block) > 1 and self.hint.search(whole := "\n".join(block)):
                units.append((first, whole))
            first, block = k + 1, []
        units.append((0, text))
        found = [(round(b[0], 9), -k, b[1]) for k, u in units if (b := self.best(u))]
        if not found:
            return None
        similarity, line, name = max(found)
        return name, similarity, -line


def spdx(text: str) -> tuple[str, float, int] | None:
    """The first SPDX identifier; of a single one without its version's range."""
    m = SPDX.search(text)
    return (m[1] if re.search(r"\s", m[1]) else _SUFFIX.sub("", m[1]), 1.0, text.count("\n", 0, m.start())) if m else None


def scan(files: DataFrame, matcher: Matcher) -> DataFrame:
    """``files`` (id, path, text) as (id, path, license, similarity, line); the last three null without match."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [matcher.scan(t) or (None, None, None) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "path": b["path"], "license": [h[0] for h in hits],
                                "similarity": pd.array([h[1] for h in hits], "Float64"), "line": pd.array([h[2] for h in hits], "Int64")})

    return files.select("id", "path", "text").mapInPandas(run, "id long, path string, license string, similarity double, line long")


def _parent(path: Column) -> Column:
    """The directory of a path, '' for the root; null for a null path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame, is_licence_file: Column) -> DataFrame:
    """``scanned`` with ``effective`` license and the directory it was ``inherited_from`` (null: its own)."""
    files = cut(scanned.withColumns({"dir": _parent(F.col("path")), "gives": F.coalesce(is_licence_file & F.col("license").isNotNull(), F.lit(False))}), "licences")
    own = (files.where("gives and dir is not null").groupBy("dir")
           .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("m")).select(F.col("dir").alias("holder"), F.col("m.license").alias("effective")))
    dirs = files.where("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    steps = F.split("dir", "/")
    up = dirs.withColumn("holder", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))),
                                                         lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    nearest = (up.join(own, "holder").groupBy("dir").agg(F.max_by(F.struct(F.col("effective").alias("theirs"), "holder"), F.length("holder")).alias("m"), F.max("n").alias("n"))
               .select("dir", "n", "m.theirs", "m.holder"))
    out = attach(files, cut(nearest, "inherited"), "dir", "n", files.count())
    takes = F.col("license").isNull()
    return out.select("id", "path", "license", "similarity", "line", F.coalesce("license", "theirs").alias("effective"),
                      F.when(takes, F.col("holder")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files of a tree source/lang/thousand/sixty-four/doc_id.txt."""
    name = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("none")), "/", "_")
    path = F.concat_ws("/", name("source"), name("lang"), F.floor(F.col("doc_id") / 1024), F.floor(F.col("doc_id") / 64), F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
