"""Licence notices by Dice coefficient over word bigrams, in DataFrame functions only.

Lines, sentences, paragraphs and whole texts are compared with licence templates (notices and whole licence texts),
all reduced to lower-case words. Of a unit only the licences with its highest coefficient count.
With a and b bigrams a Dice coefficient of t needs sizes that differ by at most the factor (2 - t) / t, so
units of other sizes are left out before their bigrams are made, and a template is compared only where the
unit's size allows it. A unit's size counts its repeated bigrams, so repetition lowers the coefficient; against templates
of more than LONG bigrams, which repeat themselves, it counts distinct ones.

A unit that reaches t shares t / (2 - t) of a template's bigrams. For each template some words are picked without
which the remaining bigrams are too few for that; units without any of these words are left out, which loses nothing.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import NOT_WORD, lower_ascii

#: Short notices by which the licences name themselves, and the opening or grant of their texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "Proprietary and confidential."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation;"),
]

#: Licences by the titles that stand in notices such as "Licensed under the ...".
TITLES: dict[str, list[str]] = {
    "MIT": ["the MIT License", "the MIT license (MIT)"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"],
    "Apache-1.1": ["the Apache License, Version 1.1", "the Apache Software License, Version 1.1"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license", "the New BSD License", "the Modified BSD License"],
    "ISC": ["the ISC License"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "MPL-1.1": ["the Mozilla Public License, version 1.1", "the Mozilla Public License 1.1"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["the Eclipse Public License, version 1.0", "the Eclipse Public License 1.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal license", "CC0"],
    "GPL": ["the GNU General Public License", "the GPL"],
    "LGPL": ["the GNU Lesser General Public License", "the LGPL"],
    "AGPL": ["the GNU Affero General Public License", "the AGPL"],
}
GNU = {"GPL": ("GNU General", "123"), "LGPL": ("GNU Lesser General", ["2.1", "3"]), "AGPL": ("GNU Affero General", ["3"])}
for _short, (_long, _versions) in GNU.items():
    for _v in _versions:
        _full = _v if "." in _v else f"{_v}.0"
        TITLES[f"{_short}-{_full}"] = [
            title for v in dict.fromkeys([_v, _full]) for title in (f"the {_long} Public License, version {v}", f"the {_long} Public License v{v}", f"the {_long} Public License version {v} or later", f"the {_short} v{v}", f"the {_short} version {v}", f"the {_short}v{v}")
        ]
TITLES["LGPL-2.0"] = ["the GNU Library General Public License, version 2", "the GNU Library General Public License, version 2.0"]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in CREATIVE.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _kind = "International" if _v == "4.0" else "Unported" if _v == "3.0" else "Generic"
        TITLES[f"CC-{_short}-{_v}"] = [f"CC {_short} {_v}", f"a Creative Commons {_long} {_v} {_kind} License", f"the Creative Commons {_long} {_v} {_kind} License", f"a Creative Commons {_long} {_v} License"]
TEMPLATES += [(name, f"{how} {title}.") for name, titles in TITLES.items() for title in titles for how in ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is released under")]

#: The GNU notices at the head of a source file.
GNU_NOTICE = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {title} Public License as published by the Free Software Foundation, "
    "either version {v} of the License, or (at your option) any later version."
)
TEMPLATES += [
    (f"{short}-{v if '.' in v else v + '.0'}", GNU_NOTICE.format(what=what, title=title, v=v))
    for short, title, v in [("GPL", "GNU General", "1"), ("GPL", "GNU General", "2"), ("LGPL", "GNU Library General", "2"), ("LGPL", "GNU Lesser General", "2.1"), ("LGPL", "GNU Lesser General", "3"), ("AGPL", "GNU Affero General", "3")]
    for what in ("program", "library")
]

#: Short licence texts; the long ones lie in the folder `licenses`.
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_2 = (
    "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES += [
    ("MIT", f"MIT License Copyright (c) {TEMPLATES[2][1]} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}"),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + BSD_3 + BSD_END),
    ("BSD-3-Clause", BSD_3),
    (
        "ISC",
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        f"present and future rights to this software under copyright law. {AS_IS} For more information, please refer to <https://unlicense.org>",
    ),
]
TEMPLATES += [(p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]

LONG = 150
#: Words too common to tell a licence, as are words of under four letters but these.
ACRONYMS = frozenset("bsd isc gnu gpl epl cc cc0 lgpl agpl".split())
COMMON = frozenset(
    "a an and any are as at available be by can do for form from has have if in into is it its made may must no not of on only or other our shall should such that the their them then there these they this those to under use "
    "used was we which who will with work works you your 0 1 2 3 4 5 all but each either more one than part public general free".split()
)


def bigrams(words: Column) -> Column:
    """The pairs of neighbouring words (one word alone: the word)."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(n >= 1, pairs).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:], strict=False))) or words


def telling_words(templates: list[list[str]], threshold: float) -> set[str]:
    """Words such that a text without any of them shares too few bigrams with each template to reach the threshold."""
    chosen: set[str] = set()
    for pairs in sorted(templates, key=len):
        least = math.ceil(threshold * (len(pairs) + math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)) / 2 - 1e-9)
        left = [p for p in map(str.split, pairs) if chosen.isdisjoint(p)]
        while len(left) >= max(least, 1):
            seen = Counter(w for p in left for w in set(p))
            chosen.add(min(seen, key=lambda w: (w in COMMON or len(w) < 4 and w not in ACRONYMS, len(w) < 6 and w not in ACRONYMS, -seen[w], -len(w), w)))
            left = [p for p in left if chosen.isdisjoint(p)]
    return chosen


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, licenses (sorted names), best_dice (null without a match), n_matches (matching units and best licences).

    A unit is a line, a sentence, a paragraph or the whole text; equal units of a document count once. Of a unit the
    licences with the highest coefficient count (several if they are equal), save where the unit lies in a longer one
    that matches another licence whose text holds the notice. Null and empty texts match nothing. Rows are told apart
    by id and text, so a repeated row gives a row for each time; an empty table gives no rows; columns besides doc_id
    and text are ignored.
    """
    known = list(dict.fromkeys((name, tuple(template_bigrams(text))) for name, text in (TEMPLATES if templates is None else templates)))
    factor = (2 - threshold) / threshold
    sets = [set(b) for _, b in known]
    held = [[j for j, (other, b) in enumerate(known) if other != name and len(b) > len(own) and len(sets[i] & sets[j]) >= threshold * len(own)] for i, (name, own) in enumerate(known)]
    shape = "array<struct<i: int, name: string, least: int, most: int, b: int, pairs: array<string>, held: array<int>>>"
    table = [
        {"i": i, "name": name, "least": math.ceil(len(b) / factor - 1e-9), "most": math.floor(len(b) * factor + 1e-9), "b": len(b), "pairs": b, "held": held[i]} for i, (name, b) in enumerate(known)
    ]
    parsed = F.from_json(F.lit(json.dumps(table)), shape)  # one constant, folded once
    telling = sorted(telling_words([list(b) for _, b in known], threshold)) or [""]

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    low = own.select("doc_id", "mark", lower_ascii(F.col("text")).alias("low"))
    told = lambda words: F.exists(words, lambda w: w.isin(telling))
    units = F.array_distinct(F.concat(F.split("low", "\n"), F.split("low", r"(?<=[.!?])\s+"), F.split("low", r"\n[\x20\t]*\n+"), F.array("low")))
    units = F.when(told(F.split("low", NOT_WORD)), units)
    rows = low.select("doc_id", "mark", F.explode(units).alias("unit")).select("doc_id", "mark", "unit", F.array_remove(F.split("unit", NOT_WORD), "").alias("words"))
    # not a filter, which would be moved below and split every unit twice
    size = F.greatest(F.size("words") - 1, F.least(F.size("words"), F.lit(1)))
    rows = rows.select("doc_id", "mark", "unit", size.alias("n"), F.when(told(F.col("words")), bigrams(F.col("words"))).alias("pairs"))
    rows = rows.withColumn("m", F.when(F.col("n") > int(LONG / factor), F.size(F.array_distinct("pairs"))).otherwise(F.col("n")))
    size = lambda t: F.when(t["b"] > LONG, F.col("m")).otherwise(F.col("n"))
    fits = F.filter(parsed, lambda t: size(t).between(t["least"], t["most"]))
    dice = F.transform(
        fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(F.col("pairs"), t["pairs"])) / (size(t) + t["b"])).alias("dice"), t["i"].alias("i"), t["name"].alias("name"), t["held"].alias("held"))
    )
    rows = rows.select("doc_id", "mark", "unit", F.when(F.col("pairs").isNotNull(), F.filter(dice, lambda d: d["dice"] >= threshold)).alias("hits"))
    hits = rows.select("doc_id", "mark", "unit", F.explode(F.filter("hits", lambda d: d["dice"] == F.array_max(F.transform("hits", lambda x: x["dice"])))).alias("hit"))
    hits = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("unit", "hit.i", "hit.name", "hit.dice", "hit.held")).alias("hits"))
    within = lambda h, g: F.array_contains(h["held"], g["i"]) & (F.length(g["unit"]) > F.length(h["unit"])) & F.contains(g["unit"], h["unit"])
    hits = hits.withColumn("hits", F.filter("hits", lambda h: ~F.exists("hits", lambda g: within(h, g))))
    hits = hits.withColumn("hits", F.array_distinct(F.transform("hits", lambda h: F.struct(h["unit"], h["name"], h["dice"]))))
    found = hits.select(
        F.col("doc_id").alias("_id"),
        F.col("mark").alias("_mark"),
        F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("licenses"),
        F.array_max(F.transform("hits", lambda h: h["dice"])).alias("best_dice"),
        F.size("hits").cast("long").alias("n_matches"),
    )
    return own.select("doc_id", "mark").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "best_dice", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches")
    )
