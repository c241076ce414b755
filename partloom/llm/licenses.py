"""Licence scan in DataFrame functions only: TF-IDF cosine of headers and licence files to templates, then inheritance.

Templates are notices, titles, SPDX lines and whole licence texts. The term weights are fitted on the templates alone, so
a text scores the same in every corpus. A header is a line or a sentence (of lines joined, comment marks taken off); each
different one is scored once, however many documents hold it. A licence file, by its name, is scored as a whole as well.

Which lines and sentences are scored follows from the templates: a header holds one of a few needles, terms chosen so
that every template has one; a text without any of them is no header.

Documents that are licence files (by name, or as a whole close to the text of one) give their licence to their directory;
a document without one of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import materialise, rows_for_broadcast

# fixed values: notices and titles of common licences
NOTICES = [
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "This work is licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "This work is licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "ISC License"),
    ("ISC", "This work is licensed under the ISC License."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This work is released under the Unlicense."),
    ("Zlib", "zlib License"),
]
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
# fixed values: texts of licences that are short enough to be given whole
TEXTS = [
    ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: First sentences of whole texts are headers too, as sources quote them without the rest.
QUOTED = [(name, re.split(r"(?<=[.:])\s", text)[0]) for name, text in TEXTS if name in ("ISC", "MIT")]
# fixed values: identifiers of the SPDX list; of GNU licences those ending with -only and -or-later too
SPDX = ["0BSD", "AFL-3.0", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib"]
LINES = [(name, f"SPDX-License-Identifier: {name}{end}") for name in SPDX for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
TEMPLATES = [*NOTICES, *QUOTED, *LINES, *TEXTS]
MIN_COSINE = 0.6
#: Directories that inherit a licence are broadcast up to this number (some 100 bytes each), and joined by a shuffle beyond.
BROADCAST_DIRS = 100_000
#: A document this close as a whole to the text of a licence is a licence file, whatever its name.
FILE_COSINE = 0.8
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.\-_].*)?$"
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: A line break with the comment mark that begins the next line.
WRAP = r"[\x20\x09\x0B\x0C\x0D]*\n[\x20\x09\x0B\x0C\x0D]*(?:(?:#+|//+|/?\*+/?|;+|--+|%+|dnl|rem)(?=[\x20\x09\x0D\n]|$)[\x20\x09]*)?"
SPACE = r"[\x20\x09-\x0D]+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@lru_cache
def fitted() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """Term weights fitted on the templates (inverse document frequency), the templates as unit vectors, and the weight of
    a term that no template has: the least, as it tells no licence from another."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES]
    n, df = len(counts), Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in sorted(df.items())}
    vectors = []
    for c in counts:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        vectors.append({t: k * idf[t] / norm for t, k in c.items()})
    return idf, vectors, 1.0


@lru_cache
def needles() -> list[str]:
    """A few terms of five letters or more, of which every template has one, within another term too: greedy set cover."""
    left, chosen = [sorted(set(re.findall(TOKEN, text.lower()))) for _, text in TEMPLATES], []
    while left:
        count = Counter(t for own in left for t in own if len(t) >= 5)
        count = {x: sum(any(x in t for t in own) for own in left) for x in count}
        chosen.append(max(count, key=lambda x: (count[x], len(x), x)))
        left = [own for own in left if not any(chosen[-1] in t for t in own)]
    return sorted(chosen)


def _cue(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in words])


def score_texts(texts: DataFrame) -> DataFrame:
    """key, text -> key, license and cosine of the best template, and file_cosine, that of the best whole licence text."""
    spark, (idf, vectors, unknown) = texts.sparkSession, fitted()
    rows = [(i, name, (name, text) in TEXTS, t, idf[t], w) for i, ((name, text), v) in enumerate(zip(TEMPLATES, vectors)) for t, w in v.items()]
    known = spark.createDataFrame(rows, "tid int, license string, whole boolean, term string, idf double, tw double")  # a few thousand rows
    terms = texts.select("key", F.explode(_tokens(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weights = F.broadcast(known.select("term", "idf").distinct())
    terms = terms.join(weights, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"), F.col("idf").isNotNull().alias("_known"))
    # the whole norm, and the terms that templates have
    slim = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("_known"), F.struct("term", "w"))).alias("_terms"))  # terms of one text that templates have
    dots = slim.select("key", "norm", F.explode("_terms").alias("t")).select("key", "norm", "t.*").join(F.broadcast(known.drop("idf")), "term").groupBy("key", "tid").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.first("norm").alias("norm"), F.first("license").alias("license"), F.first("whole").alias("whole"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = F.max(F.struct(cosine.alias("cosine"), F.col("license"))).alias("b")
    return dots.groupBy("key").agg(best, F.max(F.when(F.col("whole"), cosine)).alias("file_cosine")).select("key", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), F.coalesce("file_cosine", F.lit(0.0)).alias("file_cosine"))


def license_scan(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text", min_cosine: float = MIN_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """One row for each input row: doc_id, path, own_license, cosine, license, inherited_from.

    Null and empty texts have no licence of their own. Ties of cosine go to the licence that sorts last. A null path is
    the empty path, in the root directory. Rows that repeat path and text are answered alike; rows of one path and
    different texts each by their own text. Empty tables give no rows; other columns are ignored. Only documents with a
    header, or named as licence files, are compared as a whole.
    """
    base = docs.select(F.col(doc_id).alias("_id"), F.coalesce(path, F.lit("")).alias("_path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    folder, name = F.regexp_extract("_path", r"^(.*)/[^/]*$", 1), F.regexp_extract("_path", r"([^/]*)$", 1)
    named = name.rlike(FILE_NAMES)
    words = needles()
    some = base.where(_cue(F.lower("_text"), words) | named)
    # headers: lines, and sentences of what stands between empty lines
    blocks = F.split("_text", r"\n[\x20\x09\x0B\x0C\x0D]*\n")
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, WRAP, " "), r"(?<=[.!?:;])" + SPACE)))
    mark = r"^(?:#+|//+|/?\*+|;+|--+|%+|<!--|dnl|rem)[\x20\x09]+|[\x20\x09]*(?:\*+/|-->)$"
    pieces = F.transform(F.concat(F.split("_text", "\n"), sentences), lambda x: F.trim(F.regexp_replace(F.btrim(x, F.lit(" \t\x0b\x0c\r")), mark, "")))
    heads = F.array_distinct(F.filter(pieces, lambda x: _cue(F.lower(x), words)))
    made = some.select("_path", "_th", F.concat(F.transform(heads, lambda x: F.struct(F.lit(False).alias("_file"), x.alias("text"))), F.when((F.size(heads) > 0) | named, F.array(F.struct(F.lit(True).alias("_file"), F.col("_text").alias("text")))).otherwise(F.expr("array()"))).alias("_all"))
    # a small part of the corpus, read several times below
    lines = materialise(made.select("_path", "_th", F.explode("_all").alias("_x")).select("_path", "_th", "_x.*").withColumn("key", F.xxhash64("text")), "headers")
    scored = score_texts(lines.groupBy("key").agg(F.first("text").alias("text")))
    hits = lines.select("_path", "_th", "_file", "key").join(scored, "key")
    # what is found in a header counts for any document, the text as a whole for licence files only
    whole = F.col("_file") & (named | (F.col("file_cosine") >= file_cosine))
    good = (F.col("cosine") >= min_cosine) & (~F.col("_file") | whole)
    own = hits.where(good).groupBy("_path", "_th").agg(F.max(F.struct("cosine", "license")).alias("_b"), F.max(F.col("_file") & (F.col("file_cosine") >= file_cosine)).alias("_whole"))
    own = own.select("_path", "_th", F.col("_b.license").alias("own_license"), F.col("_b.cosine").alias("cosine"), "_whole")
    files = own.where(named | F.col("_whole")).select(folder.alias("dir"), F.struct("cosine", F.col("own_license").alias("license"), F.col("_path").alias("path")).alias("f"))
    given = files.groupBy("dir").agg(F.max("f").alias("f")).select("dir", F.col("f.license").alias("given"), F.col("f.path").alias("given_from"))
    slim = base.select("_id", "_path", "_th").withColumn("_dir", folder)
    # every different directory looks at itself and the directories above it, nearest first
    parts = F.split("_dir", "/")
    above = slim.select("_dir").distinct().select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("_depth")).select("_dir", "_depth", F.array_join(F.slice(parts, 1, F.col("_depth")), "/").alias("dir"))
    nearest = above.join(given, "dir").groupBy("_dir").agg(F.max(F.struct("_depth", "given", "given_from")).alias("_n")).select("_dir", F.col("_n.given").alias("given"), F.col("_n.given_from").alias("given_from"))
    if rows_for_broadcast(nearest, BROADCAST_DIRS):  # a directory may hold a third of all documents
        nearest = F.broadcast(nearest)
    out = slim.join(own.drop("_whole"), ["_path", "_th"], "left").join(nearest, "_dir", "left")
    return out.select(
        F.col("_id").alias(doc_id), F.col("_path").alias("path"), "own_license", "cosine", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("given_from")).alias("inherited_from")
    )
