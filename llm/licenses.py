"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Parts of every text are compared with license templates as sparse TF-IDF vectors
over the templates' words: each line, each block of lines between blank ones,
the head of the text and the text as a whole. A word of no template counts in a
part's length with the largest weight, so a notice inside other prose scores
low. A file whose matched lines hold at least half of its words is the licence
file of its directory; in any other file a match is a header that holds for the
file alone. Files without a match take the licence of the nearest directory
above that has one, by joins on directory paths.

Document frequencies count every text. The model (the templates' words) has a
fixed size, so it is all that is sent to the driver and broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from llm import arrays as A
from llm.storage import join_checked, stored

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.
You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Templates by SPDX identifier: notices of a line, headings, headers and bodies. More can be passed by the caller.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", _MIT, f"{_MIT}\n{_AS_IS}", f"MIT License Copyright (c)\n{_MIT}\n{_AS_IS}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GPL.format("", 3), _GPL.format("", 3).split("\n")[0]],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GPL.format("", 2), _GPL.format("", 2).split("\n")[0]],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GPL.format("Lesser ", 3), _GPL.format("Lesser ", 3).split("\n")[0]],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GPL.format("Affero ", 3), _GPL.format("Affero ", 3).split("\n")[0]],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", _MPL],
    "BSD-2-Clause": ["BSD 2-Clause License", _BSD, f"{_BSD}\n{_BSD_AS_IS}"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.", "BSD 3-Clause License", f"{_BSD}\n{_BSD3}", _BSD3, f"{_BSD}\n{_BSD3}\n{_BSD_AS_IS}"],
    "ISC": ["ISC License", _ISC],
    "Unlicense": [_UNLICENSE],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal"],
}
TEMPLATES = {name: [*texts, f"SPDX-License-Identifier: {name}"] for name, texts in TEMPLATES.items()}
#: Words of the head of a text that are compared as one part.
HEAD = 300
THRESHOLD, FILE_SHARE = 0.75, 0.5
_word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return _word.findall(text.lower())


class Model:
    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, threshold: float):
        self.threshold = threshold
        self.most = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for texts in templates.values() for t in texts for w in tokens(t)}
        self.vectors = []
        for name, texts in templates.items():
            for text in texts:
                v = {w: c * self.idf[w] for w, c in Counter(tokens(text)).items()}
                size = math.sqrt(sum(x * x for x in v.values()))
                self.vectors.append((name, {w: x / size for w, x in v.items()}))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v) in enumerate(self.vectors):
            for w, x in v.items():
                self.postings.setdefault(w, []).append((i, x))
        # words so common that a part of them alone can't reach the threshold with any template
        self.rare, left = set(self.idf), [0.0] * len(self.vectors)
        for word in sorted(self.idf, key=lambda w: (self.idf[w], w)):
            for i, x in self.postings[word]:
                left[i] += x * x
            if any(left[i] >= threshold**2 for i, _ in self.postings[word]):
                break
            self.rare.discard(word)

    def best(self, part: list[str]) -> tuple[float, str] | None:
        """The nearest template's cosine and name; ties go to the first name."""
        if self.rare.isdisjoint(part):
            return None
        size, score = 0.0, [0.0] * len(self.vectors)
        for w, c in Counter(part).items():
            x = c * self.idf.get(w, self.most)
            size += x * x
            for i, y in self.postings.get(w, ()):
                score[i] += x * y
        top, name = min((-x, self.vectors[i][0]) for i, x in enumerate(score))
        top = -top / math.sqrt(size)
        return (top, name) if top >= self.threshold else None

    def scan(self, text: str) -> tuple[str | None, float | None, int, int]:
        """License and cosine of the nearest part, words of all lines in a part that matched, and all words."""
        every = tokens(text)
        if self.rare.isdisjoint(every):
            return None, None, 0, len(every)
        lines = [tokens(line) for line in text.splitlines()]
        ends = [0]
        for line in lines:
            ends.append(ends[-1] + len(line))
        blank = [-1, *(i for i, line in enumerate(lines) if not line), len(lines)]
        parts = {(i, i + 1) for i, line in enumerate(lines) if line}
        parts |= {(a + 1, z) for a, z in zip(blank, blank[1:]) if z > a + 1}
        head = next((i for i, n in enumerate(ends) if n >= HEAD), len(lines))
        parts |= {(0, max(1, head)), (0, len(lines))}
        best, hit = None, set()
        for a, z in sorted(parts):
            if (got := self.best([w for line in lines[a:z] for w in line])) is not None:
                hit.update(range(a, z))
                best = got if best is None or (-got[0], got[1]) < (-best[0], best[1]) else best
        return (best[1], best[0], sum(len(lines[i]) for i in hit), len(every)) if best else (None, None, 0, len(every))


def _frequencies(words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            found: Counter = Counter()
            for text in chunk.column("text").to_pylist():
                found.update(words.intersection(tokens(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return run


_FOUND = StructType([StructField("license", StringType()), StructField("score", DoubleType()), StructField("words", IntegerType()), StructField("all_words", IntegerType())])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            cols = zip(*(shared.value.scan(text or "") for text in chunk.column("text").to_pylist()))
            found = [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([chunk.column("path"), chunk.column("kept"), *found], ["path", "kept", *_FOUND.names])

    return run


def _parent(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def licenses(files: DataFrame, *, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, path: str = "path", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """path, license, score, how (header, file, inherited or null), source_dir of each file, and `kept`: a struct of the columns `keep`.

    A file with several notices has the nearest one's license (ties: the first
    name). A directory with several licence files has the best score's (ties:
    the first name). Null paths take no part in inheritance, null and empty
    texts have no notice, repeated rows have a row each.
    """
    templates = templates or TEMPLATES
    spark = files.sparkSession
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    files = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"), kept.alias("kept"))
    words = frozenset(w for texts in templates.values() for t in texts for w in tokens(t))
    counted = files.select("text").where("text is not null").mapInArrow(_frequencies(words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    model = spark.sparkContext.broadcast(Model(templates, {r.word: r.n for r in counted}, files.count(), threshold))
    kind = StructType([*files.select("path", "kept").schema.fields, *_FOUND.fields])
    own = stored(files.mapInArrow(_scan(model), kind), "license-own")
    notice = F.col("license").isNotNull()
    own = own.withColumn("how", F.when(notice & (F.col("words") >= FILE_SHARE * F.col("all_words")), "file").when(notice, "header"))
    own = own.withColumn("dir", F.when(F.col("path").contains("/"), _parent(F.col("path"))))
    licensed = own.where("how = 'file' and dir is not null").groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license")).alias("found"))
    # each directory in use with all its ancestors; directories are far fewer than files
    dirs = own.where("how is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("ancestor", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(licensed.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "found"), "depth").alias("near"))
    joined = join_checked(own, stored(nearest, "license-nearest"), ["dir"], how="left")
    inherits = F.col("how").isNull() & F.col("near").isNotNull()
    return joined.select(
        "path",
        "kept",
        F.when(inherits, F.col("near.found.license")).otherwise(F.col("license")).alias("license"),
        F.when(inherits, F.col("near.found.score")).otherwise(F.col("score")).alias("score"),
        F.when(inherits, F.lit("inherited")).otherwise(F.col("how")).alias("how"),
        F.when(inherits, F.col("near.ancestor")).when(F.col("how") == "file", F.col("dir")).alias("source_dir"),
    )
