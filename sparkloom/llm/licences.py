"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, runs of other characters than letters and
digits are one space), line breaks included, so that wrapped notices are like
others.  Windows from every bigram of a document that a template has to every other are
compared: Dice is twice the common bigrams over the bigrams of both, counting repeated
ones.  A window of n bigrams can reach Dice d with a template of b only if n lies between
b*d/(2-d) and b*(2-d)/d, and only if it has b*d/(2-d) bigrams of the template: windows and whole documents outside of that are dropped.
Of matching windows that overlap the best is a unit.  DataFrame functions only.

Scale: one scan drops documents without any of the words that a match must have;
of the others only bigrams that some template has are shuffled, by document and template, and of these only
stretches dense enough for a match are written.  A window is at most 1.2 templates long, so that the windows of a stretch grow with its length.
Templates are parameters; they are broadcast below a checked size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_key, stash

_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1}.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.",
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_LATER, _ONLY = "either version 3 of the License, or (at your option) any later version", "version 3 of the License"
#: Licence texts and notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", " ".join(_GRANT), " ".join(_GRANT[:2]), _GRANT[0]),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (" ".join((*_BSD[:3], _BSD[4])), " ".join(_BSD[:3])),
    "BSD-3-Clause": (" ".join(_BSD), " ".join(_BSD[:4])),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", " ".join(_GNU).format("General Public License", _ONLY), _GNU[0].format("General Public License", _ONLY)),
    "GPL-3.0-or-later": (" ".join(_GNU).format("General Public License", _LATER), _GNU[0].format("General Public License", _LATER)),
    "AGPL-3.0-or-later": (" ".join(_GNU).format("Affero General Public License", _LATER), _GNU[0].format("Affero General Public License", _LATER)),
    "LGPL-3.0-or-later": (" ".join(_GNU).format("Lesser General Public License", _LATER), _GNU[0].format("Lesser General Public License", _LATER)),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
}
#: Templates of so many bigrams are broadcast; more are joined like any table.
BROADCAST_BIGRAMS = 200_000
LEAST = 0.9
#: A template's longest window in the units by which positions are ordered: windows of all templates are frames of one width.
SPAN = 1 << 32


def terms(text: Column) -> Column:
    """Normalised words."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, in order; none of fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))  # a filter above would not guard this: Spark moves filters
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def templates_of(spark, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(licence, template, size, place, bigram), a row a bigram in its place; templates of one word are left out."""
    rows = [(name, k, text) for name in templates for k, text in enumerate(templates[name])]
    t = spark.createDataFrame(rows, "licence string, template int, text string").select("licence", "template", bigrams(terms(F.col("text"))).alias("all"))
    return t.select("licence", "template", F.size("all").alias("size"), F.posexplode("all").alias("place", "bigram"))


def telling(places_of: Mapping[tuple[str, int], list[str]], least: float) -> set[str]:
    """Words of which every window with Dice `least` or more with some template has one.

    Such a window shares at least least/(2-least) of a template's bigrams; so of any
    chosen ones that are more than the rest, it has one, and the words that the
    chosen ones have in common.  Long words are chosen first.
    """
    words: set[str] = set()
    for places in places_of.values():
        spare, covered = int(len(places) - len(places) * least / (2 - least) + 1e-9), set()
        for word in sorted({w for p in places for w in p.split(" ")}, key=lambda w: (w not in words, -len(w), w)):
            if len(covered) > spare:
                break
            words.add(word)
            covered |= {k for k, p in enumerate(places) if word in p.split(" ")}
    return words


def matches(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc, first, last, licence, template, dice): from every bigram of a template in a document the window that begins there with
    the highest Dice, the longest of equals, if that is `least` or more.

    first, last: the window's first and last bigram in the document, from 0; `doc` keys id and text. Windows of b bigrams are compared with
    templates of d for all b from d * least/(2-least) to d * (2-least)/least, beyond which Dice can't be `least`; they end in bigrams of the template, since
    others at an end only lower it. A bigram counts as often as the template has it.
    """
    t = templates_of(docs.sparkSession, templates)
    places: dict[tuple[str, int], list[str]] = {}
    for r in t.collect():  # parameters, not data
        places.setdefault((r["licence"], r["template"]), []).append(r["bigram"])
    small = sum(map(len, places.values())) <= BROADCAST_BIGRAMS
    words = sorted(telling(places, least))
    low = least / (2 - least)

    t = t.groupBy("licence", "template", "size", "bigram").agg(F.count("*").alias("often"))
    if small:
        t = F.broadcast(t)
    # most documents have none of the telling words and go no further
    told = F.arrays_overlap(terms(F.col("text")), F.array(*map(F.lit, words)).cast("array<string>"))
    # a lambda's argument is evaluated once; an inner explode would have its array evaluated again, by an inferred filter
    pairs = F.transform(F.array(terms(F.col("text"))), bigrams)[0]
    d = docs.select("doc_id", "text").where(told).select(row_key().alias("doc"), pairs.alias("all"))
    each = d.select("doc", F.size("all").alias("n_doc"), F.posexplode_outer("all").alias("at", "bigram"))
    hits = each.join(t, "bigram").where(F.col("n_doc") >= F.col("size") * low)

    one = ["doc", "licence", "template"]
    hits = hits.repartition(*one).dropDuplicates([*one, "at"])  # rows alike are one; all that follows is by these keys
    # positions in units of which a window's longest length has SPAN; and how many bigrams of the template any window must have
    hits = hits.withColumn("x", F.expr(f"(bigint(at) * {SPAN}L) DIV bigint(floor(size / {low!r}D + 1e-9D))"))
    need = F.ceil(F.col("size") * F.lit(low) - 1e-9)
    along = Window.partitionBy(*one).orderBy("x")
    ahead, behind = along.rangeBetween(0, SPAN - 1), along.rangeBetween(1 - SPAN, 0)
    begins = hits.withColumn("begins", F.count("*").over(ahead) >= need)
    dense = begins.withColumn("near", F.max("begins").over(behind)).where("near").drop("near")
    # the occurrence of the same bigram that must lie before a window for this one to count in it
    same = Window.partitionBy(*one, "bigram").orderBy("at")
    before = F.lit(None).cast("int")
    for often in sorted({n for p in places.values() for n in Counter(p).values()}):
        before = F.when(F.col("often") == often, F.lag("at", often).over(same)).otherwise(before)
    dense = stash(dense.select(*one, "size", "at", "x", "begins", F.coalesce(before, F.lit(-1)).alias("before")), "hits")
    windows = dense.withColumn("ends", F.collect_list(F.struct("at", "before")).over(ahead)).where("begins")
    zero = F.struct(F.lit(0).alias("both"), F.lit(0.0).alias("dice"), F.lit(-1).alias("last"))

    def longer(s: Column, e: Column) -> Column:
        both = s["both"] + F.when(e["before"] < F.col("at"), 1).otherwise(0)
        dice = both * 2.0 / (e["at"] - F.col("at") + 1 + F.col("size"))
        better = dice >= s["dice"]
        return F.struct(both.alias("both"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, e["at"]).otherwise(s["last"]).alias("last"))

    best = windows.select(*one, F.col("at").alias("first"), F.aggregate(F.array_sort("ends"), zero, longer).alias("w"))
    return best.where(F.col("w.dice") >= least).select("doc", "first", F.col("w.last").alias("last"), "licence", "template", F.col("w.dice").alias("dice"))


def units(found: DataFrame) -> DataFrame:
    """Of matches(): (doc, licence, dice, first, last), windows none of which overlap: the one with the highest Dice first, of
    equals the longest, then by licence and place, each if none that overlaps it was taken. Windows are settled stretch by stretch."""
    order = Window.partitionBy("doc").orderBy("first", "last", "licence", "template")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = found.withColumn("new", (reach.isNull() | (F.col("first") > reach)).cast("int")).withColumn("stretch", F.sum("new").over(order))
    rank = F.struct((-F.col("dice")).alias("d"), (F.col("first") - F.col("last")).alias("l"), "licence", "first", "last")
    groups = joined.groupBy("doc", "stretch").agg(F.array_sort(F.collect_set(rank)).alias("all"))
    take = lambda a, x: F.when(F.exists(a, lambda y: (y["first"] <= x["last"]) & (y["last"] >= x["first"])), a).otherwise(F.concat(a, F.array(x)))
    kept = groups.select("doc", F.explode(F.aggregate("all", F.slice("all", 1, 0), take)).alias("x"))
    return kept.select("doc", "x.licence", (-F.col("x.d")).alias("dice"), "x.first", "x.last")


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Takes doc_id and text.  Returns a row per row of docs: doc_id, licences (of
    its units, sorted, comma-joined, '' if none), n_units and best_dice (0 if none).

    Null or empty text, or fewer than two words: no unit.  Repeated rows: a row each
    with the same figures.  No rows: no rows.  No templates: no units.
    """
    of = units(matches(docs, templates, least))
    by_doc = of.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("l"), F.count("*").alias("u"), F.max("dice").alias("d"))
    out = docs.select("doc_id", row_key().alias("doc")).join(by_doc, "doc", "left")
    return out.select("doc_id", F.coalesce("l", F.lit("")).alias("licences"), F.coalesce("u", F.lit(0)).cast("long").alias("n_units"), F.coalesce("d", F.lit(0.0)).alias("best_dice"))
