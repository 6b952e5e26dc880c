"""Licence notices in documents, by the Dice coefficient over word bigrams; DataFrame functions only.

A unit is any run of neighbouring lines, so also a line, a paragraph or a whole text, normalised to
words of letters and digits with A-Z lower-cased. Its distinct bigrams are compared with those of each
template: Dice = 2 * common / (bigrams of the unit + bigrams of the template). At a threshold t, a
unit with n bigrams can reach only templates with t / (2 - t) * n to (2 - t) / t * n of them, and
a text without any marked word of a template cannot reach it at all. Lines, paragraphs and whole
texts are compared by a join; other runs only in texts that hold t / (2 - t) of a template's bigrams
somewhere. A closest run starts at a line that brings a bigram of the template, and is followed until
it has too many bigrams.

Null and empty texts have no unit and no licence. Ties go to the template that comes first by name.
Rows that repeat a doc_id are one document and each get its licences.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.decontaminate import lower_ascii, words_of
from codequarry.llm.shared import stage

#: Dice coefficient, in percent, from which a unit is a notice.
PERCENT = 80

#: Usual notices and short licence texts.
TEMPLATES: dict[str, str] = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "all-rights-reserved": "All rights reserved.",
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-short": "Released under the MIT License.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
}

#: Words too usual to mark a licence.
USUAL = frozenset("a all an and any as at be by can for in is it may no not of on one or other out that the this "
                  "to use will with without work you".split())


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def marks(templates: dict[str, str], percent: int) -> list[str] | None:
    """Words of which a unit needs one to reach any template; None if unusual ones do not suffice.

    A unit shares at least percent / (200 - percent) of a template's bigrams, so it has one of any
    choice of more than the rest, and a word of each. The words with most bigrams are taken.
    """
    chosen: set[str] = set()
    for text in templates.values():
        grams = [set(g.split()) for g in bigrams(normal_words(text))]
        rare = Counter(w for g in grams for w in g - USUAL)
        words = iter(sorted(rare, key=lambda w: (-rare[w], w)))
        own = {w for w in rare if w in chosen}
        while sum(not g & own for g in grams) * (200 - percent) >= percent * len(grams):
            word = next(words, None)
            if word is None:
                return None
            own.add(word)
        chosen |= own
    return sorted(chosen)


def unit_bigrams(unit: Column) -> Column:
    words = words_of(lower_ascii(unit))
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, pairs), F.slice(words, 2, pairs),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def _reachable(templates: dict[str, str], percent: int):
    low = min(len(bigrams(normal_words(t))) for t in templates.values()) * percent / (200 - percent)
    need = marks(templates, percent)

    def reachable(text: str) -> Column:
        words = words_of(lower_ascii(F.col(text)))
        found = F.size(words) > low
        if need is None:
            return found
        found &= F.arrays_overlap(words, F.lit(need))
        if not all(map(str.isascii, need)):
            return found
        # most texts hold no marked word even as letters, and need not be cut into words
        return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in need])) & found

    return reachable


def reachable_texts(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    return docs.where(_reachable(templates, percent)("text"))


def licence_units(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """(id, unit): the lines, paragraphs and whole texts that some template could match."""
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n"), F.array("text")))
    return (reachable_texts(docs, templates, percent).select("id", F.explode(units).alias("unit"))
            .where(_reachable(templates, percent)("unit")))


def run_dice(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """(id, license, dice): the closest run of lines of each text to each template that one reaches."""
    grams = {name: sorted(bigrams(normal_words(t))) for name, t in sorted(templates.items())}
    grams = {name: g for name, g in grams.items() if g}
    if not grams:
        return docs.sparkSession.createDataFrame([], docs.select("id").schema.add("license", "string").add("dice", "double"))
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"), F.lit(g).alias("grams"))
                       for name, g in grams.items()])
    texts = docs.select("id", "text", F.array_intersect(
        unit_bigrams(F.col("text")), F.lit(sorted(set().union(*grams.values())))).alias("hit"))
    near = F.filter(listed, lambda t: F.size(F.array_intersect(t["grams"], F.col("hit"))) * (200 - percent) >= t["size"] * percent)
    held = texts.select("id", "text", F.explode(near).alias("t")).select("id", "text", "t.*")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: words_of(lower_ascii(x))), lambda w: F.size(w) > 0)
    held = stage(held.select("id", "license", "size", "grams", lines.alias("lines")))

    def pairs(words: Column) -> Column:
        n = F.size(words) - 1
        return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    # of each line its own bigrams, and those with the last word of the line before
    joined = F.transform("lines", lambda w, k: F.struct(pairs(w).alias("own"), F.when(k == 0, pairs(w)).otherwise(
        pairs(F.concat(F.slice(F.get("lines", k - 1), -1, 1), w))).alias("after")))
    held = stage(held.select("id", "license", "size", "grams", joined.alias("lines")))
    brings = lambda x: F.coalesce(F.arrays_overlap(x, F.col("grams")), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: brings(F.get("lines", k)["own"])
                      | brings(F.get("lines", k + 1)["after"]))
    held = stage(held.select("*", starts.alias("starts")))

    def follow(state: Column, line: Column) -> Column:
        def judged(seen: Column) -> Column:
            n, common = F.size(seen), F.size(F.array_intersect(seen, F.col("grams")))
            reached = common * 200 >= (n + F.col("size")) * percent
            return F.struct(seen.alias("seen"), F.greatest(state["dice"], F.when(
                reached, 2 * common / (n + F.col("size"))).otherwise(0.0)).alias("dice"), F.lit(False).alias("first"))

        added = F.array_union(state["seen"], F.when(state["first"], line["own"]).otherwise(line["after"]))
        open_ = F.size(state["seen"]) * percent <= F.col("size") * (200 - percent)
        # one element, so that the union is made once
        return F.when(open_, F.transform(F.array(added), judged)[0]).otherwise(state)

    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0.0).alias("dice"), F.lit(True).alias("first"))
    best = F.array_max(F.transform("starts", lambda k: F.aggregate(
        F.slice(F.col("lines"), k + 1, F.size("lines")), empty, follow, lambda state: state["dice"])))
    return held.select("id", "license", F.round(best, 6).alias("dice")).where("dice > 0")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, gram), one row per distinct bigram of each template."""
    rows = [(name, len(grams), g) for name, text in sorted(templates.items())
            for grams in [bigrams(normal_words(text))] for g in sorted(grams)]
    return spark.createDataFrame(rows, "license string, size int, gram string")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, best, dice): names of the templates that some unit of the document reaches,
    the closest one and its coefficient, rounded to six places; none: empty, null, 0."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = F.broadcast(template_table(docs.sparkSession, templates))  # as large as the list given
    units = licence_units(rows, templates, percent)
    units = (units.select("id", F.xxhash64("unit").alias("unit_key"), unit_bigrams(F.col("unit")).alias("g"))
             .withColumn("n", F.size("g")).where("n > 0"))
    common = (units.select("id", "unit_key", "n", F.explode("g").alias("gram")).join(table, "gram")
              .where((F.col("size") * percent <= F.col("n") * (200 - percent))
                     & (F.col("n") * percent <= F.col("size") * (200 - percent)))
              .groupBy("id", "unit_key", "n", "license", "size").agg(F.count_distinct("gram").alias("common"))
              .where(F.col("common") * 200 >= F.col("n") * percent + F.col("size") * percent))
    best = (common.select("id", "license", F.round(2 * F.col("common") / (F.col("n") + F.col("size")), 6).alias("dice"))
            .unionByName(run_dice(reachable_texts(rows, templates, percent), templates, percent))
            .groupBy("id", "license").agg(F.max("dice").alias("dice"))
            .groupBy("id").agg(F.array_sort(F.collect_list("license")).alias("licenses"),
                               F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("first")))
    found = stage(best.select("id", "licenses", F.col("first.license").alias("best"), (-F.col("first.d")).alias("dice")))
    return (rows.select("id").alias("r").join(found.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")), "left")
            .select("r.id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "best",
                    F.coalesce("dice", F.lit(0.0)).alias("dice")))
