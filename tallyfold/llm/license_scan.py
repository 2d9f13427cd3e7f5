"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Segments of a document are its lines, the whole text, and windows of a template's size wherever the text may hold the template,
over line ends or inside longer lines.  A segment and a template are normalised (lower case, words of a-z and 0-9), turned into
multisets of word bigrams (one word alone: that word), and compared by 2 |A and B| / (|A| + |B|).  As the intersection is at
most the smaller size, a coefficient of t or more needs |B| between t/(2-t) |A| and (2-t)/t |A|: templates outside these size
bounds are not compared.  A window has the size n of its template, so t n bigrams must be common, and any n - ceil(t n) + 1
of the template's must include a common one: its anchors, the longest bigrams, of those first the ones in fewer templates.
Windows begin where an anchor aligns, at the nearest place inside the text.

Edge cases: a null, empty or wordless text matches nothing.  Ties go to the template named first.  Texts are scanned whole,
however long; repeated rows match alike; an empty table gives no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import lean, slices, texts, with_column_names

#: Notices, openings and short texts of public licences (name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
THRESHOLD = 0.8
WORD = re.compile("[a-z0-9]+")


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 1 else words


def anchors(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(template number, place, bigram) of the bigrams of which a window at the threshold has one."""
    known = [bigrams(WORD.findall(t.lower())) for _, t in templates]
    spread = Counter(g for own in known for g in set(own))
    out = []
    for k, own in enumerate(known):
        need = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
        out += [(k, at, own[at]) for at in sorted(range(len(own)), key=lambda i: (-len(own[i]), spread[own[i]], i))[:need]]
    return out


class Matcher:
    """Templates by size, so that the size bounds are two binary searches."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        known = [(k, name, Counter(bigrams(WORD.findall(t.lower())))) for k, (name, t) in enumerate(templates)]
        self.known = sorted(((sum(c.values()), k, name, c) for k, name, c in known if c), key=lambda x: x[:2])
        self.sizes = [x[0] for x in self.known]
        self.threshold, self.first = threshold, {b for x in self.known for b in x[3]}
        self.by_number = {k: (n, name, c) for n, k, name, c in self.known}
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for k, at, gram in anchors(templates, threshold):
            self.anchors.setdefault(gram, []).append((k, at))

    def candidates(self, size: int):
        t, slack = self.threshold, 1e-9
        return self.known[bisect_left(self.sizes, t / (2 - t) * size - slack) : bisect_right(self.sizes, (2 - t) / t * size + slack)]

    def best(self, segment: str) -> tuple[float, int, str] | None:
        """(dice, template number, name) of the best template at the threshold or above."""
        words = WORD.findall(segment.lower())
        size = max(len(words) - 1, min(len(words), 1))
        tried = self.candidates(size) if size else ()
        if not tried:
            return None
        mine, out = Counter(bigrams(words)), None
        if self.first.isdisjoint(mine):
            return None
        for n, k, name, of in tried:
            dice = 2 * sum((mine & of).values()) / (size + n)
            if dice >= self.threshold and (out is None or (-dice, k) < (-out[0], out[1])):
                out = (dice, k, name)
        return out

    def windows(self, words: list[str]) -> Iterator[tuple[float, int, str]]:
        """(dice, template number, name) of the windows of templates' sizes that reach the threshold."""
        grams, tried = bigrams(words), set()
        for p, gram in enumerate(grams):
            for k, at in self.anchors.get(gram, ()):
                n, name, of = self.by_number[k]
                if n <= len(grams) and (place := (k, max(0, min(p - at, len(grams) - n)))) not in tried:
                    tried.add(place)
                    dice = 2 * sum((Counter(grams[place[1] : place[1] + n]) & of).values()) / (2 * n)
                    if dice >= self.threshold:
                        yield dice, k, name

    def scan(self, text: str) -> tuple[str | None, float, int, str | None]:
        """(licence, dice, licences, their names) of the lines, the whole text and the windows."""
        lines = text.split("\n")
        hits = [h for s in (lines if len(lines) == 1 else [*lines, text]) if s and (h := self.best(s))]
        hits += self.windows(WORD.findall(text.lower()))
        if not hits:
            return None, 0.0, 0, None
        top, names = min(hits, key=lambda h: (-h[0], h[1])), sorted({h[2] for h in hits})
        return top[2], top[0], len(names), ",".join(names)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, n_licenses, licenses of every document (null, 0 where none matches); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in slices(batches, "text"):
            out = [matcher.scan(t) for t in texts(b)]
            cols = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "license", "dice", "n_licenses", "licenses"])

    docs = with_column_names(docs, "doc_id", "text")
    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, license string, dice double, n_licenses long, licenses string")
