"""License scans: a trained paragraph classifier, confirmed by templates.

The classifier is a multinomial logistic regression over word 1- and 2-grams with an L1
penalty, which leaves few weights. It is fitted here, at the driver, from the fixed
notices below in several openings, against paragraphs that only sound like licences and
notices without their cores. A first fit leaves out the last notice of each family, every
other paragraph that is no licence, and all notices of a few more families, which stand for
those that nobody listed. On them the temperature of the softmax is calibrated, and the
least probability, under which a paragraph is ``unknown``; the model itself is fitted to
all listed notices then.

A prediction counts only if a template of the family confirms it: its core, the words in
brackets that tell the licence from its kin, stands in the paragraph word for word, and so
do CONFIRM_PERCENT of its words, and no word near the core denies it ("not under the ...",
"moved away from ..."). Else the paragraph is ``unknown``.

A paragraph is a line, or, since notices are wrapped and stand in comments, a line with
those that follow it: up to a line without words, or until these have as many words as the
longest template. Such a run counts only if it is confirmed, by CONFIRM_PERCENT of a
template's pairs of neighbouring words too, as single words are met by chance in longer
texts. Of runs of one family that overlap, the one that shares most with a template is
given, and none where a line among them is confirmed by itself.

Scoring uses DataFrame operations only. Texts and lines without any of the cue words are
left out before it: each core holds one, so none of these could be confirmed. The weights
and templates that are broadcast are bounded by the notices below.

Defined cases: null text has no paragraphs; lines of any length are scored whole; a
repeated row gives its rows again; rows without an identifier are scored like others; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize

#: Short notices of licence families, as their stewards publish them; the core of each in brackets.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the [Apache License, Version 2.0].",
        'Licensed under the [Apache License, Version 2.0] (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, [software distributed under the License is distributed on an "AS IS" BASIS], WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is available under the [Apache 2.0 License].",
    ),
    "MIT": (
        "Released under the [MIT License].",
        '[Permission is hereby granted, free of charge, to any person obtaining a copy of this software] and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "This code is distributed under the terms of the [MIT License].",
        "An [MIT licence].",
    ),
    "ISC": (
        "Released under the [ISC License].",
        "[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted], provided that the above copyright notice and this permission notice appear in all copies.",
        "This code is distributed under the terms of the [ISC License].",
    ),
    "BSD": (
        "[Redistribution and use in source and binary forms, with or without modification, are permitted] provided that the following conditions are met:",
        "Use of this source code is governed by a [BSD-style license] that can be found in the LICENSE file.",
    ),
    "BSD-2-Clause": ("Released under the [BSD 2-Clause License].", "Licensed under the [Simplified BSD License].", 'Licensed under the [BSD 2-Clause "Simplified" License].'),
    "BSD-3-Clause": (
        "Released under the [BSD 3-Clause License].",
        "[Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products] derived from this software without specific prior written permission.",
        "Licensed under the [New BSD License].",
        'Licensed under the [BSD 3-Clause "New" or "Revised" License].',
    ),
    "GPL-2.0": (
        "This work is licensed under the [GNU General Public License, version 2].",
        "This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License as published by the Free Software Foundation; either version 2] of the License, or (at your option) any later version.",
        "Licensed under the [GPLv2 license].",
    ),
    "GPL-3.0": (
        "This work is licensed under the [GNU General Public License, version 3].",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License as published by the Free Software Foundation, either version 3] of the License, or (at your option) any later version.",
        "Licensed under the [GPLv3 license].",
    ),
    "LGPL-2.1": (
        "This library is licensed under the [GNU Lesser General Public License, version 2.1].",
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1] of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the [GNU Lesser General Public License, version 3].",
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License as published by the Free Software Foundation; either version 3] of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the [GNU Affero General Public License, version 3].",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License as published by the Free Software Foundation, either version 3] of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("Licensed under the [Mozilla Public License, version 2.0].", "This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0]."),
    "EPL-2.0": ("Licensed under the [Eclipse Public License 2.0].", "This program and the accompanying materials are made available under the terms of the [Eclipse Public License v. 2.0].", "Licensed under the [Eclipse Public License, version 2.0]."),
    "Unlicense": ("[This is free and unencumbered software released into the public domain].", "Released under the [Unlicense]."),
    "BSL-1.0": ("Distributed under the [Boost Software License, Version 1.0].", "Licensed under the [Boost Software License 1.0]."),
    "Zlib": (
        "[This software is provided 'as-is', without any express or implied warranty]. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the [zlib License].",
    ),
    "CC0-1.0": (
        "Released into the public domain under [CC0 1.0].",
        "To the extent possible under law, the author has waived all copyright and related rights under [CC0 1.0 Universal] public domain dedication.",
    ),
}
#: The other Creative Commons licences, by the part of their names that differs.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NOTICES |= {
    f"CC-{code}-4.0": (f"Licensed under [CC {code} 4.0].", f"This work is licensed under a [Creative Commons {name} 4.0 International License].", f"This text is available under the [Creative Commons {name} 4.0] licence.")
    for code, name in COMMONS.items()
}
#: SPDX identifiers where they aren't the family's name.
SPDX = {name: (f"{name}-only", f"{name}-or-later") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")} | {"BSD": ()}
NOTICES = {family: (*(f"SPDX-License-Identifier: {x}".replace("SPDX", "[SPDX") + "]" for x in SPDX.get(family, (family,))), *notices) for family, notices in NOTICES.items()}
#: How licences are named in passing, with a word that says licence.
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2", "Apache 2 license", "Apache-2.0 license", "Apache Software License 2.0"),
    "MIT": ("MIT licence", "MIT/Expat license", "Expat license"),
    "ISC": ("ISC licence",),
    "BSD-2-Clause": ("2-clause BSD license", "two-clause BSD license", "BSD-2-Clause license", "FreeBSD license"),
    "BSD-3-Clause": ("3-clause BSD license", "three-clause BSD license", "BSD-3-Clause license", "modified BSD license", "revised BSD license"),
    "GPL-2.0": ("version 2 of the GNU General Public License", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL v2 license", "GPL v2 license", "GPL-2.0 license"),
    "GPL-3.0": ("version 3 of the GNU General Public License", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL v3 license", "GPL v3 license", "GPL-3.0 license"),
    "LGPL-2.1": ("version 2.1 of the GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "LGPLv2.1 license", "LGPL v2.1 license", "LGPL-2.1 license"),
    "LGPL-3.0": ("version 3 of the GNU Lesser General Public License", "GNU Lesser General Public License v3", "LGPLv3 license", "LGPL v3 license", "LGPL-3.0 license"),
    "AGPL-3.0": ("version 3 of the GNU Affero General Public License", "GNU Affero General Public License v3", "AGPLv3 license", "AGPL v3 license", "AGPL-3.0 license"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0 license", "MPL-2.0 license"),
    "EPL-2.0": ("Eclipse Public License v2.0", "EPL 2.0 license", "EPL-2.0 license"),
    "Unlicense": ("The Unlicense",),
    "BSL-1.0": ("Boost Software License", "BSL-1.0 license"),
    "Zlib": ("zlib licence", "zlib/libpng license"),
    "CC0-1.0": ("CC0 license", "CC0-1.0 license", "CC0 1.0 license"),
} | {f"CC-{code}-4.0": (f"CC {code} 4.0 license", f"CC-{code}-4.0 license", f"Creative Commons {name} 4.0 International license") for code, name in COMMONS.items()}
#: Short forms that stand after "license" or "licensed under".
SHORT = {
    "Apache-2.0": ("Apache-2.0", "Apache 2.0"), "MIT": ("MIT",), "ISC": ("ISC",), "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",),
    "GPL-2.0": ("GPLv2", "GPL v2", "GNU GPL v2", "GNU GPLv2", "GPL-2.0"), "GPL-3.0": ("GPLv3", "GPL v3", "GNU GPL v3", "GNU GPLv3", "GPL-3.0"), "LGPL-2.1": ("LGPLv2.1", "LGPL v2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("LGPLv3", "LGPL v3", "GNU LGPL v3", "LGPL-3.0"), "AGPL-3.0": ("AGPLv3", "AGPL v3", "GNU AGPL v3", "AGPL-3.0"), "MPL-2.0": ("MPL-2.0", "MPL 2.0"), "EPL-2.0": ("EPL-2.0", "EPL 2.0"),
    "BSL-1.0": ("BSL-1.0",), "Zlib": ("zlib",), "CC0-1.0": ("CC0", "CC0-1.0"),
} | {f"CC-{code}-4.0": (f"CC-{code}-4.0",) for code in COMMONS}
#: Addresses of the Creative Commons licences.
ADDRESSES = {"CC0-1.0": "https://[creativecommons.org/publicdomain/zero/1.0]/ has the public domain dedication."} | {f"CC-{code}-4.0": f"License: https://[creativecommons.org/licenses/{code.lower()}/4.0]/" for code in COMMONS}
NOTICES = {
    family: (
        *notices,
        *(f"Licensed under [{x}]." for x in NAMES.get(family, ())),
        *(form.format(x) for x in SHORT.get(family, ()) for form in ('"[license": "{}]"', "[License: the {}]", "[Licensed under {}].", "[Licensed under the {}].")),
        *([ADDRESSES[family]] if family in ADDRESSES else []),
    )
    for family, notices in NOTICES.items()
}
#: Words that deny a licence which is named up to REACH words after them, and what denies it after its name.
DENYING = (
    "not", "no", "never", "nor", "neither", "longer", "cannot", "isn", "aren", "wasn", "weren", "don", "doesn", "didn", "away", "unlike", "instead", "rather", "formerly", "previously", "former", "previous",
    "incompatible", "except", "dropped", "drops", "abandoned", "replaced", "replaces", "replacing",
)
DENIED_AFTER = r"^(?:\S+ ){0,4}(?:no longer|not apply|not cover|not the license|not our|is not|are not|was replaced|was dropped|incompatible|until)(?: |$)"
REACH = 6
#: Notices of families that aren't told apart here; only the calibration sees them.
UNLISTED = (
    "Licensed under the European Union Public Licence, version 1.2.",
    "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself, under the Artistic License 2.0.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License, version 1.0.",
    "This software is released under the Python Software Foundation License, version 2.",
    "Licensed under the Microsoft Public License.",
    "SPDX-License-Identifier: Foo-1.0",
    "Released under the terms of the Beerware License.",
    "Licensed under the GNU Free Documentation License, version 1.3.",
)
#: Paragraphs with cue words that are no licence of any family.
OTHERS = (
    "All rights reserved.",
    "All rights reserved by the author and the publisher of this book.",
    "The driver lost the license after the third offence.",
    "Copyright of the photographs remains with the museum.",
    "A warranty of two years comes with every machine.",
    "The license fee is due at the beginning of the year.",
    "You need a fishing license for this lake.",
    "Our license agreement for enterprise customers is available on request.",
    "This software is proprietary and may not be copied.",
    "The public domain of the city includes its parks and squares.",
    "See the terms of the agreement for details about the warranty.",
    "An apache helicopter landed near the village.",
    "The general public was invited to the opening.",
    "The commons are open to the public, version 2 of the plan says.",
    "Licensed premises close at midnight.",
    "The film was released under a new title in version 3.",
    "Licensed under the terms of a contract between the parties.",
    "The tool is free software in the sense that nobody pays for it.",
    "Redistribution of income was the subject of the debate.",
    "Permission to land was refused twice that night.",
    "Released under licence to a foundation, version 1.0 of the report.",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "The second version of the report was published by the foundation for the general public.",
    "Version 3 of the plan lists the terms under which the work may go on.",
    "The free software movement and its foundation are the subject of chapter 2.",
    "This file is part of the collection and may be used by the public.",
    "The software is released in version 2.0 with a new license dialog.",
    "Creative people use the commons, in version 4.0 of the international guide.",
    "The software comes without any warranty, see the license of the vendor.",
    "Public radio stations share a license and the terms of its use.",
)
#: Other openings and endings of a notice.
OPENINGS = ("{}", "This project is {}", "Note: {}", "{} See the file for details.", "(c) the authors. {}", "The text of this page: {}")
#: At least one of them is in a paragraph about a licence, and one in the core of each notice.
CUES = (
    "licen[sc]e", "copyright", "redistribut", "permission is hereby", "permission to use", "public domain", "creative commons", "creativecommons", "without warrant",
    "without any express", "spdx", "cc by", "cc0", "all rights reserved",
)

UNKNOWN = "unknown"
CONFIRM_PERCENT = 60
STEPS, RATE, PENALTY = 150, 2.0, 1e-4
#: Of held-out paragraphs of no listed family, so many may pass for one before templates are compared.
MOST_WRONG = 0.05

_WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Comment markers that are words; all others have no letters.
_WORD_MARKS = r"(?i)^\s*(?:dnl|rem)\b"
#: Each line's words with those of the lines that follow it, and how many lines these are.
_RUNS = """transform(by_line, (own, i) -> aggregate(slice(by_line, i + 2, {longest}),
  named_struct('words', own, 'n', 1, 'more', 0, 'over', size(own) = 0),
  (s, x) -> CASE WHEN s.over OR size(x) = 0 OR s.more >= {longest} THEN named_struct('words', s.words, 'n', s.n, 'more', s.more, 'over', true)
            ELSE named_struct('words', concat(s.words, x), 'n', s.n + 1, 'more', s.more + size(x), 'over', false) END))"""


def words_of(paragraph: str) -> list[str]:
    return re.findall(_WORD, paragraph.lower())


def pairs_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates() -> list[tuple[str, str, list[str], list[str]]]:
    """(family, core, words, pairs) of each notice."""
    found = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = words_of(notice)
            core = " ".join(words_of(notice[notice.index("[") : notice.index("]")]))
            found.append((family, f" {core} ", sorted(set(words)), pairs_of(words)))
    return found


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def variants() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(family, paragraph) to fit, and to calibrate with: other notices, families and openings."""
    fit, held = [], []
    for family, notices in NOTICES.items():
        for k, notice in enumerate(notices):
            last = k == len(notices) - 1 and len(notices) > 2
            (held if last else fit).extend((family, opening.format(notice)) for opening in OPENINGS)
    fit += [(UNKNOWN, opening.format(p)) for p in OTHERS[::2] for opening in OPENINGS]
    # What is left of a notice without its core names no licence.
    fit += [(UNKNOWN, re.sub(r"\[.*\]", "", notice)) for notices in NOTICES.values() for notice in notices if not notice.startswith("[")]
    held += [(UNKNOWN, opening.format(p)) for p in (*OTHERS[1::2], *UNLISTED) for opening in OPENINGS[:2]]
    return fit, held


def _matrix(rows: list[tuple[str, str]], names: list[str]) -> np.ndarray:
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (_, p) in enumerate(rows):
        mine = [place[f] for f in features_of(words_of(p)) if f in place]
        x[r, mine] = 1.0 / np.sqrt(max(len(mine), 1))
    return x


def _trained(rows: list[tuple[str, str]], classes: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Feature names, weights (features x classes) and bias, by accelerated proximal gradient steps."""
    counts: dict[str, int] = {}
    for _, p in rows:
        for f in features_of(words_of(p)):
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= 3)
    x, y = _matrix(rows, names), np.array([classes.index(f) for f, _ in rows])
    # Families have different numbers of notices; each weighs the same. In a family, a notice weighs as the root of its length.
    length = np.sqrt([len(words_of(p)) for _, p in rows])
    share = length / np.bincount(y, length, len(classes))[y]
    share = (share / share.sum())[:, None]
    target = np.eye(len(classes))[y]
    weight, bias = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    ahead, step = weight, 1.0
    for _ in range(STEPS):
        gap = (_softmax(x @ ahead + bias) - target) * share
        new = ahead - RATE * (x.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - RATE * PENALTY, 0.0)
        bias = bias - RATE * gap.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * step * step)) / 2
        ahead, weight, step = new + (step - 1) / faster * (new - weight), new, faster
    return names, weight, bias


@functools.cache
def fit() -> dict:
    """The classes, weights by feature, bias, temperature and the least probability."""
    rows, held = variants()
    classes = sorted({f for f, _ in rows})
    names, weight, bias = _trained(rows, classes)
    scores = _matrix(held, names) @ weight + bias
    y = np.array([classes.index(f) for f, _ in held])
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(held)), y] + 1e-12).mean())
    other = y == classes.index(UNKNOWN)
    # The least probability under which few paragraphs of no listed family pass for one.
    wrong = np.sort(np.delete(_softmax(scores / temperature)[other], classes.index(UNKNOWN), axis=1).max(axis=1))
    least = float(wrong[int(np.ceil(len(wrong) * (1 - MOST_WRONG))) - 1])
    listed = [(f, p) for f, p in held if f != UNKNOWN]
    names, weight, bias = _trained(rows + listed, classes)
    used = np.abs(weight).max(axis=1) > 1e-6
    return {
        "classes": classes,
        "weights": {f: [round(float(w), 6) for w in weight[k]] for k, f in enumerate(names) if used[k]},
        "bias": [round(float(b), 6) for b in bias],
        "temperature": temperature,
        "least": round(least, 6),
        "names": names,
    }


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a cue, and runs of lines with a core: doc_id, row, line_no, n_lines, words."""
    cue = "|".join(CUES)
    # A cue of several words may be wrapped, too.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("(?i)" + cue.replace(" ", "[^A-Za-z0-9]+(?:(?:dnl|rem)[^A-Za-z0-9]+)?")))
    by_line = F.transform(F.split("text", "\n", -1), lambda line: F.regexp_extract_all(F.lower(F.regexp_replace(line, _WORD_MARKS, "")), F.lit(_WORD), 0))
    longest = max(len(words_of(t)) for notices in NOTICES.values() for t in notices)
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), by_line.alias("by_line")).withColumn("runs", F.expr(_RUNS.format(longest=longest)))
    both = F.flatten(F.zip_with("by_line", "runs", lambda line, run: F.array(F.struct(F.lit(1).alias("n_lines"), line.alias("words")), F.struct(run["n"].alias("n_lines"), run["words"].alias("words")))))
    units = rows.select("doc_id", "row", F.posexplode(both).alias("unit", "of")).select("doc_id", "row", F.floor(F.col("unit") / 2).alias("line_no"), (F.col("unit") % 2 == 1).alias("is_run"), "of.*")
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    cores = "|".join(sorted({re.escape(core).replace("\\ ", " ").replace("\\-", "-") for _, core, _, _ in templates()}))
    wanted = F.when(F.col("is_run"), (F.col("n_lines") > 1) & text.rlike(cores)).otherwise(text.rlike(cue))
    return units.filter(wanted).drop("is_run")


def _denied(text: Column, core: Column) -> Column:
    """Whether words shortly before a core, or after it, deny the licence that it names."""
    before = F.call_function("substring_index", text, core, F.lit(1))
    after = F.call_function("substring", text, F.length(before) + F.length(core) + 1)
    near = F.slice(F.reverse(F.split(F.trim(before), " ")), 1, REACH)
    return F.arrays_overlap(near, F.array(*map(F.lit, DENYING))) | after.rlike(DENIED_AFTER)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a cue word and per wrapped notice: doc_id, line_no (from 0; the first of a wrapped notice), n_lines, family, predicted, probability, confirmed."""
    spark = docs.sparkSession
    model = fit()
    classes = model["classes"]
    weights = spark.createDataFrame([(f, model["weights"].get(f, [0.0] * len(classes))) for f in model["names"]], "feature string, weight array<double>")
    known = {family: [(core, words, pairs) for f, core, words, pairs in templates() if f == family] for family in classes}
    compared = spark.createDataFrame(list(known.items()), "predicted string, templates array<struct<core:string,words:array<string>,pairs:array<string>>>")

    units = materialize(_units(docs, id_col, text_col), "license-units")
    key = ["row", "line_no", "n_lines"]
    pairs = F.filter(F.zip_with(F.col("words"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    # The words stay behind, so that a line of many words isn't copied for each of them.
    exploded = units.select(*key, F.explode(F.array_union("words", pairs)).alias("feature"))
    scored = exploded.join(F.broadcast(weights), "feature").groupBy(*key).agg(
        F.count("weight").alias("known"), *[F.sum(F.col("weight")[k]).alias(f"s{k}") for k in range(len(classes))]
    )
    per = F.sqrt(F.greatest(F.coalesce("known", F.lit(0)), F.lit(1)))
    logits = F.array(*[(F.coalesce(f"s{k}", F.lit(0.0)) / per + F.lit(model["bias"][k])) / model["temperature"] for k in range(len(classes))])
    scored = units.join(scored, key, "left").select("doc_id", *key, "words", logits.alias("logits"))
    scored = scored.withColumn("powers", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))))
    best = F.array_position("powers", F.array_max("powers"))
    scored = scored.withColumn("probability", F.array_max("powers") / F.aggregate("powers", F.lit(0.0), lambda a, x: a + x))
    scored = scored.withColumn("predicted", F.element_at(F.array(*map(F.lit, classes)), best.cast("int"))).drop("logits", "powers")

    joined = scored.join(F.broadcast(compared), "predicted").withColumn("pairs", pairs).withColumn("text", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    fits = F.filter("templates", lambda t: F.col("text").contains(t["core"]) & (100 * F.size(F.array_intersect(t["words"], "words")) >= CONFIRM_PERCENT * F.size(t["words"])) & ~_denied(F.col("text"), t["core"]))
    share = F.array_max(F.transform(fits, lambda t: F.size(F.array_intersect(t["pairs"], "pairs")) / F.greatest(F.size(t["pairs"]), F.lit(1))))
    joined = joined.withColumn("share", share).drop("templates", "pairs", "text", "words")
    confirmed = F.col("share").isNotNull() & (F.col("probability") >= model["least"]) & ((F.col("n_lines") == 1) | (100 * F.col("share") >= CONFIRM_PERCENT))
    joined = joined.withColumn("confirmed", confirmed).filter("n_lines = 1 OR confirmed").withColumn("end", F.col("line_no") + F.col("n_lines"))
    # Confirmed paragraphs of a family that overlap are one group; lines go before runs.
    of = Window.partitionBy("row", "predicted", "confirmed")
    reach = F.max("end").over(of.orderBy("line_no", "n_lines").rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("starts", F.when(F.col("line_no") < reach, 0).otherwise(1))
    joined = joined.withColumn("group", F.sum("starts").over(of.orderBy("line_no", "n_lines").rowsBetween(Window.unboundedPreceding, 0)))
    of_group = Window.partitionBy("row", "predicted", "confirmed", "group")
    lines = F.count_if(F.col("n_lines") == 1).over(of_group)
    rank = F.row_number().over(of_group.orderBy(F.desc("share"), "n_lines", F.desc("line_no")))
    joined = joined.withColumns({"lines": lines, "rank": rank}).filter("n_lines = 1 OR lines = 0 AND rank = 1")
    # A line that a confirmed run takes in has no word of its own.
    covered = F.max(F.when(F.col("confirmed"), F.col("end"))).over(Window.partitionBy("row").orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0))
    joined = joined.withColumn("covered", F.coalesce(covered > F.col("line_no"), F.lit(False))).filter("confirmed OR NOT covered")
    family = F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN)
    return joined.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("n_lines").cast("long").alias("n_lines"), family.alias("family"), "predicted", F.round("probability", 6).alias("probability"), "confirmed")
