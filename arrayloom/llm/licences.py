"""Licence scans by sparse TF-IDF cosine, with inheritance along paths, in DataFrame functions only.

A text's segments (lines and sentences, empty ones left out) are joined to runs
of some lengths that begin at, or just before, a segment with an anchor word.
Where lines are so short that the longest run has fewer terms than a template,
windows of the template's own number of terms begin there as well.
Runs, windows, and whole texts that are no longer than a template may be, are held against
templates by the cosine of their TF-IDF vectors; term frequencies in documents are
counted over all texts. SPDX tags are read as they stand. Texts without a licence
take that of the nearest directory above that has a licence file, known by its name or,
where names say nothing, by the share of its terms that its licence holds.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import packed, staged

# Public licence texts and notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "MIT License. Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    (
        "MIT",
        """MIT License Copyright (c)
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *[
        (
            name,
            f"""This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
            This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
            You should have received a copy of the GNU {kind}General Public License along with this {thing}. If not, see https://www.gnu.org/licenses/.""",
        )
        for name, thing, mark, kind, n in (
            ("GPL-3.0", "program", ":", "", "3"), ("GPL-2.0", "program", ";", "", "2"), ("LGPL-3.0", "library", ":", "Lesser ", "3"), ("LGPL-2.1", "library", ";", "Lesser ", "2.1"), ("AGPL-3.0", "program", ":", "Affero ", "3"),
        )
    ],
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0. Definitions. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    *[
        (
            name,
            f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
            Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
            Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
            {third}
            THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        )
        for name, third in (
            ("BSD-2-Clause", ""),
            ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        )
    ],
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. See the Unlicense."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."),
    *[(f"CC-{kind}-4.0", text.format(kind.replace("BY-", "BY-"))) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for text in ("Licensed under CC {} 4.0.", "Available under CC {} 4.0.")],
    *[
        (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ],
]
#: Words without which no run is looked at: every template has some.
ANCHOR = "(?i)licen[cs]|copyright|permission|permitted|redistribut|warrant|public domain|as-is|free software|\\bcc0\\b"
TAG = "(?i)SPDX-License-Identifier:\\s*\\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
LICENCE_FILE = "(?i)^(un)?(licen[cs]e|copying|copyright)([-_.][^/]*)?$"
TERM = "[^a-z0-9.+-]+"
SEGMENT = "\n|(?<=[.!?;])\\s+"
#: Segments in a run; segments, and terms of shorter ones, before an anchored one at which runs may begin.
RUNS, BEFORE, BEFORE_TERMS = (1, 2, 3, 4, 5, 7, 10, 14, 20, 28), 2, 12
#: Terms of the pieces that a segment longer than every template is cut into.
PIECE = 8
#: Terms beyond which a run or whole text isn't held against templates, all of which have fewer than half as many: what it holds of one stands in its shorter runs and windows.
MOST_TERMS = 600


def terms(text: Column) -> Column:
    """Lower-case terms, without full stops at their ends; comment marks give none."""
    split = F.split(F.lower(F.regexp_replace(text, "\\.+(?=[^A-Za-z0-9]|$)", " ")), TERM)
    return F.filter(split, lambda x: x.rlike("[a-z0-9]"))


def templates(spark) -> DataFrame:
    """(template, licence, term, tf) of TEMPLATES: a bounded table."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, text string")
    return rows.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))


def weights(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(term, idf) of the templates' terms, from all texts; and the row null with that of any other term."""
    here = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = texts.select(F.explode(here).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = texts.sparkSession.createDataFrame([(t,) for t in [*vocabulary, None]], "term string")
    total = texts.agg(F.count(F.lit(1))).scalar()
    idf = F.log((total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return staged(known.join(counts, "term", "left").select("term", idf.alias("idf")), "idf")


def cosines(units: DataFrame, spark, idf: DataFrame, least: float) -> DataFrame:
    """units (row_, unit, share, terms) with their best template: row_, unit, share, licence, score of at least `least`.

    Terms outside the templates weigh as terms that no text has, each occurrence
    on its own: that bounds a vector's length from below only by repeats.
    """
    t = templates(spark).join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    long = t.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    t = staged(t.join(long, "template").select(F.col("term").alias("term_"), "template", "licence", (F.col("w") / F.col("length")).alias("tw")), "templates")
    other = idf.filter("term is null").select("idf").scalar()
    tf = units.select("row_", "unit", "share", F.explode("terms").alias("term")).groupBy("row_", "unit", "share", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(F.broadcast(idf.filter("term is not null")), "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
    square = F.when(F.col("idf").isNull(), F.col("tf") * other * other).otherwise(F.col("w") * F.col("w"))
    length = F.sqrt(F.sum("square").over(W.partitionBy("row_", "unit"))).alias("length")
    w = w.withColumn("square", square).select("row_", "unit", "share", "term", "w", length)
    dot = w.join(F.broadcast(t), F.col("term") == F.col("term_")).groupBy("row_", "unit", "share", "template", "licence").agg((F.sum(F.col("w") * F.col("tw")) / F.first("length")).alias("score"))
    best = dot.groupBy("row_", "unit", "share").agg(F.max(F.struct(F.round("score", 9).alias("score"), "licence")).alias("x")).select("row_", "unit", "share", F.col("x.licence").alias("licence"), F.col("x.score").alias("score"))
    return best.filter(F.col("score") >= least)


def parents(path: Column) -> Column:
    """All directories above a path, with their depths: '' is the root, of depth 0."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))


def units_of(anchored: DataFrame, lengths: list[int]) -> DataFrame:
    """(row_, unit, share, terms) of anchored (row_, text): runs of segments, windows of `lengths` terms where runs are shorter, and as unit 0, whole texts; share: their part of the text's terms.

    Segments of more terms than any of `lengths` are cut into pieces.
    """
    size, longest = F.col("all"), max(lengths)
    segment = lambda x: F.struct(terms(x).alias("terms"), x.rlike(ANCHOR).alias("anchor"))
    piece = lambda t: F.struct(t.alias("terms"), F.array_join(t, " ").rlike(ANCHOR).alias("anchor"))
    pieces = lambda s: F.transform(F.sequence(F.lit(1), F.size(s["terms"]), F.lit(PIECE)), lambda i: piece(F.slice(s["terms"], i, F.lit(PIECE))))
    cut = anchored.withColumn("segments", F.filter(F.transform(F.split("text", SEGMENT), segment), lambda x: F.size(x["terms"]) > 0))
    some_long = F.exists("segments", lambda s: F.size(s["terms"]) > longest)
    cut = cut.withColumn("segments", F.when(some_long, F.flatten(F.transform("segments", lambda s: F.when(F.size(s["terms"]) > longest, pieces(s)).otherwise(F.array(s))))).otherwise(F.col("segments")))
    each = F.transform("segments", lambda x: x["terms"]).alias("each")
    light = F.transform("segments", lambda x: F.struct(F.size(x["terms"]).alias("n"), x["anchor"].alias("anchor"))).alias("light")
    total = F.aggregate("segments", F.lit(0), lambda n, x: n + F.size(x["terms"])).alias("total")
    cut = cut.select("row_", each, light, F.size("segments").alias("all"), total)

    def near(i: Column) -> Column:
        """Whether an anchored segment is at most BEFORE segments, or BEFORE_TERMS terms, after the i-th begins."""
        start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("found"))
        step = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["found"] | (x["anchor"] & (s["n"] <= BEFORE_TERMS))).alias("found"))
        by_terms = F.aggregate(F.slice("light", i, F.lit(BEFORE_TERMS + 1)), start, step, lambda s: s["found"])
        return F.exists(F.slice("light", i, F.lit(BEFORE + 1)), lambda x: x["anchor"]) | by_terms

    width = lambda i: F.aggregate(F.slice("light", i, F.lit(RUNS[-1])), F.lit(0), lambda n, x: n + x["n"])
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (i <= size) & near(i))
    starts = F.transform(starts, lambda i: F.struct(i.alias("i"), width(i).alias("width")))
    unit = lambda i, k: (i.cast("long") * 10_000 + k).alias("unit")
    whole = F.struct(F.lit(1).alias("s"), size.alias("n"), F.lit(0).cast("long").alias("unit"), F.lit(0).alias("window"))
    runs = F.transform(starts, lambda x: F.transform(F.array(*map(F.lit, RUNS)), lambda n: F.struct(x["i"].alias("s"), n.alias("n"), unit(x["i"], n), F.lit(0).alias("window"))))
    runs = F.filter(F.flatten(runs), lambda r: r["s"] + r["n"] - 1 <= size)
    longer = lambda x: F.filter(F.array(*map(F.lit, lengths)), lambda n: n > x["width"])
    # A segment has a term at least, so n of them hold a window of n terms.
    windows = F.flatten(F.transform(starts, lambda x: F.transform(longer(x), lambda n: F.struct(x["i"].alias("s"), n.alias("n"), unit(x["i"], n + RUNS[-1]), n.alias("window")))))
    out = cut.select("row_", "each", "total", F.inline(F.concat(F.array(whole), runs, windows)))
    held = F.flatten(F.slice("each", F.col("s"), F.col("n")))
    out = out.select("row_", "unit", "window", "total", F.when(F.col("window") > 0, F.slice(held, F.lit(1), F.greatest("window", F.lit(1)))).otherwise(held).alias("terms"))
    out = out.filter(F.size("terms").between(F.greatest("window", F.lit(1)), MOST_TERMS))
    return out.select("row_", "unit", (F.size("terms") / F.col("total")).alias("share"), "terms")


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", least: float = 0.8, giving_share: float | None = None) -> DataFrame:
    """Every row of docs, without its text, as the struct `row`, with licence, score, and how: tag, file, header, inherited or null.

    A row's own licence is that of its SPDX tag (the first; score 1), else of its
    best whole text (file) or run of segments (header). Only a path whose name is
    that of a licence file (LICENSE, COPYING.txt, ...) gives its own licence to its
    folder; with `giving_share`, where names say nothing, so does a text of which one
    whole text, run or window of its own licence holds at least that share of the terms
    (a tag speaks for its own text alone). Others take that of the nearest such folder
    above. Ties go to the higher score, then the later name. Null texts have no licence
    of their own, null paths inherit none; repeated rows are judged alike; an empty table gives
    no rows. Lines may be of any width: a template stands in a run or a window. A
    short notice amid an unpunctuated line longer than all templates is diluted
    by the words beside it, as that line is only cut into pieces of PIECE terms.
    """
    spark = docs.sparkSession
    plain = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = packed(docs, row_=F.xxhash64(docs[f"`{doc_id}`"].isNull(), docs[f"`{doc_id}`"], docs[f"`{path}`"], docs[f"`{text}`"]), text=plain, path=docs[f"`{path}`"], tag=F.nullif(F.regexp_extract(plain, TAG, 1), F.lit("")))
    known = templates(spark).collect()
    vocabulary = sorted({r.term for r in known})
    sizes = Counter()
    for r in known:
        sizes[r.template] += r.tf
    idf = weights(rows.select("text"), vocabulary)
    anchored = staged(rows.filter(F.col("text").rlike(ANCHOR) & F.col("tag").isNull()).select("row_", "text"), "anchored").dropDuplicates(["row_"])
    found = staged(cosines(units_of(anchored, sorted(set(sizes.values()))), spark, idf, least), "found")
    own = found.groupBy("row_", "licence").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max(F.col("unit") == 0).alias("whole"))
    own = own.groupBy("row_").agg(F.max(F.struct("score", "licence", "share")).alias("x"), F.max("whole").alias("whole"))
    own = staged(own.select(F.col("row_").alias("r_"), F.col("x.licence").alias("own"), F.col("x.score").alias("score"), F.col("x.share").alias("share"), F.when(F.col("whole"), "file").otherwise("header").alias("how")), "own")
    rows = rows.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text]))
    light = rows.drop("text").join(own, F.col("row_") == F.col("r_"), "left").drop("r_")
    tagged = F.col("tag").isNotNull()
    light = light.withColumns({"own": F.coalesce("tag", "own"), "score": F.when(tagged, 1.0).otherwise(F.col("score")), "how": F.when(tagged, "tag").otherwise(F.col("how"))})
    light = light.withColumn("above", F.element_at(parents(F.col("path")), -1)["folder"])
    is_file = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    gives = F.col("own").isNotNull() & (is_file if giving_share is None else is_file | (F.col("tag").isNull() & (F.col("share") >= giving_share)))
    folders = light.filter(gives & F.col("path").isNotNull()).groupBy(F.col("above").alias("folder_")).agg(F.max(F.struct("score", "own")).alias("x"))
    folders = staged(folders.select("folder_", F.col("x.own").alias("given"), F.col("x.score").alias("given_score")), "folders")
    # Rows of one folder inherit alike, so each folder looks up once.
    wants = light.filter("own is null and path is not null").select(F.col("above").alias("p_"), parents(F.col("path")).alias("all")).distinct()
    wants = wants.select("p_", F.inline("all"))
    nearest = wants.join(folders, F.col("folder") == F.col("folder_")).groupBy("p_").agg(F.max(F.struct("depth", "given", "given_score")).alias("g"))
    nearest = staged(nearest, "nearest")
    out = light.join(nearest, (F.col("above") == F.col("p_")) & F.col("own").isNull(), "left")
    inherited = F.when(F.col("g").isNotNull(), "inherited")
    return out.select("row", F.coalesce("own", "g.given").alias("licence"), F.coalesce("score", "g.given_score").alias("score"), F.coalesce("how", inherited).alias("how"))
