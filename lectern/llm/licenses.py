"""Licence scan in DataFrame operations only: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its sentences (over line ends), its blank-line paragraphs and the text itself, so a
notice is found in a longer text, wrapped, behind other sentences, or whole. Templates are whole notices and, of
longer ones, their paragraphs and sentences, unless another licence has the same. A unit is normalised to
lower-case words and compared with those templates alone whose number of bigrams can reach the threshold at its
own number; it stands for the licence of its best template, so that versions of a licence are told apart.

Words that any match must hold follow from the bound on Dice; units without one of them are passed over, and none is lost.
"""

from __future__ import annotations

import math
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held

# Public licence notices in their usual wording; blank lines part paragraphs.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Licensed under the GNU General Public License v3.0."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
THRESHOLD = 0.8
#: Words of a template's paragraph or sentence, at least, for it to stand for the licence.
LEAST_WORDS = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH_END = r"\n[\x20\t\r]*\n"
SENTENCE_END = r"[.!?][\x20\t\r\n]+|" + PARAGRAPH_END


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def _bigrams_of(text: str) -> tuple[str, ...]:
    ws = _words(text)
    return tuple(sorted({f"{a} {b}" for a, b in zip(ws, ws[1:])}))


def patterns(templates: list[tuple[str, str]]) -> list[tuple[str, tuple[str, ...]]]:
    """(licence, bigrams) of the notices and of their parts that are long enough and no other licence's."""
    whole = [(name, _bigrams_of(text)) for name, text in templates]
    parts = [(name, _bigrams_of(part)) for name, text in templates for split in (PARAGRAPH_END, SENTENCE_END) for part in re.split(split, text) if len(_words(part)) >= LEAST_WORDS]
    owners: dict[tuple[str, ...], set[str]] = {}
    for name, grams in whole + parts:
        owners.setdefault(grams, set()).add(name)
    return sorted({(name, grams) for name, grams in whole + parts if (name, grams) in whole or len(owners[grams]) == 1})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Set sizes m with 2 min(n, m) / (n + m) >= threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


#: Words that most texts hold: as cues they are the last choice. They only make the filter coarser or finer, never its result.
COMMON = frozenset("a all an and any are as at be by can for from if in is it may not of on or other that the this to under use was with without you your".split())


def cues(templates: list[tuple[str, ...]], threshold: float = THRESHOLD) -> set[str]:
    """Words one of which any unit holds that reaches the threshold with one of the templates (sets of bigrams).

    Of a template with m bigrams a unit of n, at least m t / (2 - t), must hold t (n + m) / 2 or more, so it may lack fewer
    than m - m t / (2 - t) + 1 of them. Words whose bigrams are at least so many can't all be lacking: words are added
    until each template has that many, those first that serve many templates and are long and rare.
    """
    left = [(set(g), len(g) - math.ceil(len(g) * threshold / (2 - threshold) - 1e-9) + 1) for g in templates if g]
    chosen: set[str] = set()
    while left:
        use: dict[str, float] = {}
        for grams, needed in left:
            held: dict[str, int] = {}
            for g in grams:
                for w in set(g.split(" ")):
                    held[w] = held.get(w, 0) + 1
            for w, n in held.items():
                use[w] = use.get(w, 0) + min(n, needed) / needed
        best = min(use, key=lambda w: ((100.0 if w in COMMON or w.isdigit() else 10 / len(w)) / use[w], w))
        chosen.add(best)
        now = [({g for g in grams if best not in g.split(" ")}, needed, len(grams)) for grams, needed in left]
        left = [(grams, needed - before + len(grams)) for grams, needed, before in now if needed > before - len(grams)]
    return chosen


#: Every character that parts words, each of which becomes a blank.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _spaced(text: Column) -> Column:
    """The text with a blank for each character that parts words, and one at both ends."""
    return F.concat(F.lit(" "), F.translate(text, SEPARATORS, " " * len(SEPARATORS)), F.lit(" "))


def _normal_words(spaced: Column) -> Column:
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def _bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(transform(slice({words}, 1, greatest(size({words}) - 1, 0)), (x, i) -> concat(x, ' ', {words}[i + 1])))")


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def units(documents: DataFrame, id_col: str, text_col: str, wanted: set[str]) -> DataFrame:
    """(key, kind, unit_no, words) of the units with a word of wanted: lines, sentences, paragraphs of several lines, and the text if it has several paragraphs."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cued(spaced: Column) -> Column:
        return reduce(operator.or_, [F.contains(spaced, F.lit(f" {w} ")) for w in sorted(wanted)])

    def tagged(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit_no"), u.alias("unit")))

    several = F.transform(F.split("held_text", PARAGRAPH_END), lambda p: F.when(F.contains(F.trim(p), F.lit("\n")), p).otherwise(""))
    whole = F.when(F.col("held_text").rlike(PARAGRAPH_END), F.array("held_text")).otherwise(F.array().cast("array<string>"))
    kinds = [("line", F.split("held_text", "\n")), ("sentence", F.split("held_text", SENTENCE_END)), ("paragraph", several), ("text", whole)]
    every = F.concat(*[tagged(kind, parts) for kind, parts in kinds])
    rows = held(documents.select(_key(id_col, text_col).alias("key"), text.alias("body")), "held_text", F.lower("body"))
    rows = held(rows, "held_spaced", _spaced(F.col("held_text"))).where(cued(F.col("held_spaced"))).drop("held_spaced")
    flat = rows.select("key", F.explode(every).alias("u")).select("key", "u.kind", "u.unit_no", "u.unit")
    flat = held(flat, "spaced", _spaced(F.col("unit"))).where(cued(F.col("spaced")))
    return held(flat, "words", _normal_words(F.col("spaced"))).drop("unit", "spaced")


def matches(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, kind, unit_no, dice, licenses) of each unit whose best template reaches the threshold: the licences of templates that are best alike."""
    grams = patterns(templates)
    bounds = [size_bounds(len(g), threshold) for _, g in grams]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    found = units(documents, id_col, text_col, cues([g for _, g in grams], threshold)).where(F.size("words") >= low + 1)
    found = held(found, "grams", _bigrams("words")).withColumn("n", F.size("grams")).where(F.col("n").between(low, high))
    scores = [
        F.when(F.col("n").between(*b), F.struct((2 * F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / (F.col("n") + len(g))).alias("dice"), F.lit(name).alias("license")))
        for (name, g), b in zip(grams, bounds)
    ]
    found = held(found.select("key", "kind", "unit_no", F.filter(F.array(*scores), lambda s: s["dice"] >= threshold).alias("over")), "top", F.array_max("over.dice")).where("top is not null")
    return found.select("key", "kind", "unit_no", F.col("top").alias("dice"), F.array_distinct(F.transform(F.filter("over", lambda s: s["dice"] == F.col("top")), lambda s: s["license"])).alias("licenses"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, licenses (sorted array), n_units matched, best_dice (null if none).

    Other columns are not read. Null and empty texts match nothing; texts of any length are scanned whole; templates that are best alike keep all
    their licences; repeated rows are answered one by one; an empty table gives an empty result.
    """
    per_doc = matches(documents, id_col, text_col, templates, threshold).groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("licenses")))).alias("found"), F.count_distinct("kind", "unit_no").alias("hit_units"), F.max("dice").alias("top"))
    base = documents.select(F.col(id_col), _key(id_col, text_col).alias("base_key"))
    both = base.join(per_doc, F.col("base_key").eqNullSafe(F.col("key")), "left")
    return both.select(id_col, F.coalesce("found", F.array().cast("array<string>")).alias("licenses"), F.coalesce("hit_units", F.lit(0)).alias("n_units"), F.col("top").alias("best_dice"))
