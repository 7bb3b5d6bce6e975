"""License scan: sparse TF-IDF cosine to templates, then the nearest licensed ancestor directory.

Only DataFrame functions.  A file's header pieces are the lines and the blocks of lines (up to a
line without letters) that hold a trigger word; a licence file is compared by its whole text as
well.  Terms are runs of ``[a-z0-9.]`` of the lower-cased piece.  The weight of a term is its
count times ln((1 + files) / (1 + files that hold it)) + 1, with the document frequencies of all
terms of templates and pieces over all files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# Passages that several licences share.
_FSF = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {version} of the License,"
    " or any later version."
)
_GNU_HEAD = (
    "{title} {version} Copyright Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
)
_GNU = (
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written"
    " permission."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,"
    " EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER"
    " CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN"
    " IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices and texts of public licences by SPDX id.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
        " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
        " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
        " USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _FSF.format(work="program", name="GNU General Public License", version="either version 2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FSF.format(work="program", name="GNU General Public License", version="either version 3")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _FSF.format(work="library", name="GNU Lesser General Public License", version="either version 2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _FSF.format(work="library", name="GNU Lesser General Public License", version="either version 3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _FSF.format(work="program", name="GNU Affero General Public License", version="either version 3")),
    *((name, _GNU_HEAD.format(title=title, version=version)) for name, title, version in _GNU),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THREE} {_BSD_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
        " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: A line without any of these is no header line.
TRIGGERS = r"(?i)licen[cs]|copyright|permission|redistribut|free software|creative commons|public domain|\bcc0\b"

TERM = "[a-z0-9.]*[a-z0-9]"

#: What parts blocks: line ends with nothing but marks of comments between them.
BLOCK_END = r"\n(?:[\t\r *#/;-]*\n)+"


@dataclass(frozen=True)
class LicenseParams:
    """templates: (SPDX id, text) pairs; full texts of more licences may be added to the fixed ones."""

    least_cosine: float = 0.6
    licence_file: str = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-.][-.a-z0-9]+)?$"
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, idf`` of each of ``terms``, from all files."""
    spark = texts.sparkSession
    held = F.array_distinct(_terms(F.coalesce("text", F.lit(""))))
    df = texts.select(F.explode(F.array_append(held, F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # After the aggregate, so that no join meets a common term once for each file; '' counts the files.
    df = settle(df.join(terms.union(spark.createDataFrame([("",)], "term string")), "term", "left_semi"), "df")
    files = df.filter("term = ''").select(F.col("df").alias("files"))
    known = terms.join(df, "term", "left").crossJoin(F.broadcast(files))
    idf = F.log((F.lit(1.0) + F.col("files")) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
    return settle(known.select("term", idf.alias("idf")), "idf")


def best_templates(pieces: DataFrame, texts: DataFrame, params: LicenseParams) -> DataFrame:
    """``key, license, cosine`` of each piece of text (by the digest that stands for it) that has a template near enough."""
    spark = pieces.sparkSession
    templates = spark.createDataFrame([(k, *t) for k, t in enumerate(params.templates)], "template int, license string, body string")
    counted = templates.select("template", "license", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    tf = pieces.select("key", F.explode(_terms(F.col("piece"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    tf = settle(tf, "piece-terms")
    idf = frequencies(texts, settle(counted.select("term").union(tf.select("term")).distinct(), "terms"))
    weights = F.broadcast(counted).join(idf, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("t"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    weights = F.broadcast(weights.join(norms, "template"))
    own = tf.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("p"))
    own = settle(own, "weights")
    length = own.groupBy("key").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("p_norm"))
    dots = own.join(weights, "term").groupBy("key", "template", "license", "t_norm").agg(F.sum(F.col("p") * F.col("t")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("t_norm") / F.col("p_norm"), 6)
    near = dots.join(length, "key").select("key", "license", cosine.alias("cosine")).filter(F.col("cosine") >= params.least_cosine)
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license")).alias("best"))
    return best.select("key", "best.license", (-F.col("best.order")).alias("cosine"))


def directory_of(path: Column) -> Column:
    """What is before the last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory, the ones above it and the top (empty), nearest first, as (depth, name)."""
    parts = F.split(directory, "/")
    names = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("name")))
    return F.when(directory == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("name")))).otherwise(
        F.concat(names, F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"))))
    )


def scan_licenses(
    files: DataFrame,
    params: LicenseParams = LicenseParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    path: Column | None = None,
    licence_file: Column | None = None,
) -> DataFrame:
    """Per row ``doc_id, path, own_license, cosine, license, inherited_from``.

    path: the file's path (default: column ``path``).  own_license: of the template with the
    greatest cosine, at least ``least_cosine``, to any header line or block, or to the whole text of a
    licence file (by its name, or by the column ``licence_file``); ties go to the first licence by name; null if none.  license: own_license, else
    that of the nearest directory at or above the file's own which has a licence file with a
    licence; of several the one most files name, then the first by name.  inherited_from: that
    directory, null if the licence is the file's own or there is none.  Null texts are empty and
    have no licence; null paths lie at the top.  Rows may repeat, with one id and path too, and are
    judged each by its own text; other columns are ignored.
    """
    place = F.coalesce(path if path is not None else F.col("path"), F.lit(""))
    name = F.regexp_extract(place, r"(?s)([^/]*)$", 1)
    base = files.select(
        F.col(id_col).alias("doc_id"),
        place.alias("path"),
        (licence_file if licence_file is not None else name.rlike(params.licence_file)).alias("is_licence"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    none = F.array().cast("array<string>")
    cut = F.concat(F.split("text", "\n"), F.split("text", BLOCK_END))
    heads = F.when(F.col("text").rlike(TRIGGERS), F.filter(cut, lambda piece: piece.rlike(TRIGGERS))).otherwise(none)
    whole = F.when(F.col("is_licence") & (F.col("text") != ""), F.array("text")).otherwise(none)
    pieces = F.array_distinct(F.concat(heads, whole)).alias("pieces")
    held = settle(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "is_licence", pieces), "headers")
    found = held.filter(F.size("pieces") > 0).select("row", F.explode("pieces").alias("piece"))
    found = found.withColumn("key", F.unhex(F.sha2("piece", 256)))  # stands for the text in all shuffles
    distinct = found.groupBy("key").agg(F.any_value("piece").alias("piece"))
    best = settle(best_templates(distinct, base.select("text"), params), "licensed-lines")
    own = found.select("row", "key").join(best, "key").groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license")).alias("best"))
    own = settle(own.select("row", F.col("best.license").alias("own_license"), (-F.col("best.order")).alias("cosine")), "own-licenses")
    rows = held.drop("pieces").join(own, "row", "left").drop("row").withColumn("directory", directory_of(F.col("path")))
    voted = rows.filter("is_licence and own_license is not null").groupBy("directory", "own_license").agg(F.count("*").alias("n"))
    licensed = voted.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("order"), "own_license")).alias("v"))
    licensed = licensed.select(F.col("directory").alias("name"), F.col("v.own_license").alias("given"))
    tree = rows.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.depth", "a.name")
    nearest = tree.join(licensed, "name").groupBy("directory").agg(F.max(F.struct("depth", "name", "given")).alias("near"))
    return rows.join(nearest, "directory", "left").select(
        "doc_id",
        "path",
        "own_license",
        "cosine",
        F.coalesce("own_license", F.col("near.given")).alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.name")).alias("inherited_from"),
    )


def document_path(id_col: str = "doc_id") -> Column:
    """Documents have no paths: the query lays them out by source, language and hundreds of ids;
    every tenth lies a level higher, every fiftieth directly under its source."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    n = F.coalesce(F.col(id_col), F.lit(0))
    leaf = F.concat(F.lit("/"), n.cast("string"), F.lit(".txt"))
    by_lang = F.concat(named("source"), F.lit("/"), named("lang"))
    deep = F.concat(by_lang, F.lit("/"), F.floor(n / 100).cast("string"), leaf)
    return F.when(n % 50 == 0, F.concat(named("source"), leaf)).when(n % 10 == 0, F.concat(by_lang, leaf)).otherwise(deep)
