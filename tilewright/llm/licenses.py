"""Licence scan by sentence recognition: known sentences become identifiers, and ordered rules read the identifiers.

A text is cut into sentences, a sentence is normalised, and the normal form is looked up among the known
licence sentences. Rules are tried in their order on the document's identifiers: a rule that finds its
sequence takes those sentences, so a later, more general rule cannot claim them again, nor reach over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BROADCAST_LIMIT_BYTES, at_work, sliced, table

# Names under which notices speak of public licences, by the identifier that rules use.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("mit-notice", ("mit license", "expat license")),
    ("bsd-notice", ("bsd license",)),
    ("bsd-2-notice", ("bsd 2-clause license", "2-clause bsd license", "simplified bsd license")),
    ("bsd-3-notice", ("bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license")),
    ("isc-notice", ("isc license",)),
    ("zlib-notice", ("zlib license",)),
    ("boost-notice", ("boost software license, version 1.0", "boost software license 1.0")),
    ("apache-2-notice", ("apache license, version 2.0", "apache license, version 2.0 (the \"license\")", "apache license 2.0", "apache 2.0 license")),
    ("gpl-3-notice", ("gnu general public license, version 3", "gnu general public license version 3", "gnu general public license v3.0", "gnu gpl v3")),
    ("gpl-2-notice", ("gnu general public license, version 2", "gnu general public license version 2", "gnu general public license v2.0", "gnu gpl v2")),
    ("lgpl-notice", ("gnu lesser general public license",)),
    ("lgpl-2.1-notice", ("gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1")),
    ("lgpl-3-notice", ("gnu lesser general public license, version 3", "gnu lesser general public license version 3")),
    ("agpl-3-notice", ("gnu affero general public license, version 3", "gnu affero general public license version 3")),
    ("mpl-2-notice", ("mozilla public license, version 2.0", "mozilla public license 2.0")),
    ("epl-2-notice", ("eclipse public license, version 2.0", "eclipse public license 2.0", "eclipse public license v2.0")),
    ("epl-1-notice", ("eclipse public license, version 1.0", "eclipse public license v1.0")),
    ("artistic-2-notice", ("artistic license 2.0", "artistic license, version 2.0")),
    ("ofl-notice", ("sil open font license, version 1.1", "sil open font license 1.1")),
    ("unlicense-notice", ("unlicense",)),
    ("wtfpl-notice", ("wtfpl",)),
    ("cc-by-notice", ("cc by 4.0", "creative commons attribution 4.0 international license")),
    ("cc-by-sa-notice", ("cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license")),
    ("cc-by-nd-notice", ("cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license")),
    ("cc-by-nc-notice", ("cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license")),
    ("cc-by-nc-sa-notice", ("cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0 international license")),
    ("cc-by-nc-nd-notice", ("cc by-nc-nd 4.0", "creative commons attribution-noncommercial-noderivatives 4.0 international license")),
    ("cc0-notice", ("cc0 1.0", "cc0 1.0 universal")),
)
#: Openings of a notice; each goes before each name, with and without an article.
OPENINGS = ("licensed under", "released under", "distributed under", "available under", "published under")
SUBJECTS = ("", "this project is ", "this work is ", "this software is ", "this file is ", "the code is ")

# Sentences of public licences, with the identifiers that rules use.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("mit-keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so"),
    ("as-is", "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("no-liability", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-grant", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("zlib-as-is", "this software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice-kept", "this notice may not be removed or altered from any source distribution"),
    ("boost-grant", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following"),
    ("boost-grant", "distributed under the boost software license, version 1.0"),
    ("apache-2-title", "apache license version 2.0, january 2004"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at"),
    ("apache-2-as-is", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2-limits", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3-or-later", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("gpl-2-or-later", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-2.1-or-later", "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version"),
    ("lgpl-3-or-later", "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("agpl-3-or-later", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("mpl-2-copy", "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0"),
    ("epl-2-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at"),
    ("ofl-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of the font software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the font software, subject to the following conditions"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain-any", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("wtfpl-grant", "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0-waiver", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("reserved", "all rights reserved"),
    ("confidential", "this document is confidential and proprietary"),
)


def known_sentences() -> tuple[tuple[str, str], ...]:
    """The sentences of the licences, and a notice for each subject, opening, article and name."""
    notices = (
        (kind, f"{subject}{opening} {article}{name}")
        for kind, names in NAMES for name in names for subject in SUBJECTS for opening in OPENINGS for article in ("", "the ", "a ", "the terms of the ")
    )
    return (*SENTENCES, *notices)


#: Ordered rules, the more specific first: name and the identifiers that have to follow each other.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-keep", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT-0", ("mit-0-grant", "as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-comply", "apache-2-copy", "apache-2-as-is", "apache-2-limits")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-comply")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("MIT", ("mit-notice",)),
    ("BSD-2-Clause", ("bsd-2-notice",)),
    ("BSD-3-Clause", ("bsd-3-notice",)),
    ("BSD", ("bsd-notice",)),
    ("BSD", ("bsd-grant",)),
    ("ISC", ("isc-notice",)),
    ("Zlib", ("zlib-notice",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("Apache-2.0", ("apache-2-notice",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-or-later",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("LGPL-2.1", ("lgpl-2.1-notice",)),
    ("LGPL-3.0", ("lgpl-3-notice",)),
    ("LGPL", ("lgpl-notice",)),
    ("AGPL-3.0", ("agpl-3-notice",)),
    ("MPL-2.0", ("mpl-2-notice", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("EPL-2.0", ("epl-2-notice",)),
    ("EPL-1.0", ("epl-1-notice",)),
    ("Artistic-2.0", ("artistic-2-notice",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("OFL-1.1", ("ofl-grant",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Unlicense", ("public-domain", "public-domain-any")),
    ("Unlicense", ("unlicense-notice",)),
    ("Public-Domain", ("public-domain",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("WTFPL", ("wtfpl-notice",)),
    ("Proprietary", ("reserved",)),
    ("Proprietary", ("confidential",)),
)

_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
# A sentence ends at a run of . ; : ! ? before white space or the end; the first mark after a lone "v" is
# no end. A run is taken whole and only from its beginning, so leaders of dots cost linear time.
_END = re.compile(r"(?<!\bv)(?<![.;:!?])[.;:!?]++(?=\s|$)|(?<=\bv[.;:!?])[.;:!?]++(?=\s|$)|\n\s*\n")
_LINE = re.compile(r"\n+")
_SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)")


def normal(sentence: str) -> str:
    """Lower-case words joined by single spaces; comment marks, quotes and punctuation go, licence is spelled license."""
    return " ".join(_WORD.findall(sentence.lower().replace("licence", "license")))


@dataclass(frozen=True)
class Book:
    """Known sentences by normal form, and the rules. ``cues``: words of which every known sentence has one."""

    known: dict[str, str]
    rules: tuple[tuple[str, tuple[str, ...]], ...]
    cues: tuple[str, ...]

    @classmethod
    def of(cls, sentences: Sequence[tuple[str, str]] | None = None, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Book:
        known: dict[str, str] = {}
        for name, text in known_sentences() if sentences is None else sentences:
            # A known text is read as texts are: where a sentence ends inside it, its longest part stands for it.
            for part in sorted((normal(x) for x in _END.split(text)), key=len)[-1:]:
                known.setdefault(part, name)
        # Few words that cover all sentences, found greedily: a text without any of them is not cut at all.
        rest, cues = [set(s.split()) for s in known], []
        while rest:
            count: dict[str, int] = {}
            for s in rest:
                for w in s:
                    if len(w) > 4:
                        count[w] = count.get(w, 0) + 1
            if not count:
                cues.append("")
                break
            best = min(count, key=lambda w: (-count[w], w))
            cues.append(best)
            rest = [s for s in rest if best not in s]
        return cls(known, tuple((n, tuple(s)) for n, s in rules), tuple(c.replace("license", "licen") for c in cues))


@lru_cache(maxsize=1)
def default_book() -> Book:
    return Book.of()


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Sentences as (start, end): first with every line end as an end, then those that run over line ends."""
    for lines in (True, False):
        cuts = sorted({m.span() for m in _END.finditer(text)} | ({m.span() for m in _LINE.finditer(text)} if lines else set()))
        at = 0
        for a, b in [*cuts, (len(text), len(text))]:
            if a > at and (lines or "\n" in text[at:a]):
                yield at, a
            at = max(at, b)


def identify(text: str, book: Book) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of all known sentences, in order; the same identifier counts once per place."""
    low = text.lower()
    if not any(c in low for c in book.cues):
        return []
    found: dict[tuple[int, str], int] = {}
    for a, b in pieces(text):
        if (name := book.known.get(normal(text[a:b]))) is not None:
            while text[a].isspace():
                a += 1
            found.setdefault((a, name), b)
    return sorted((a, b, n) for (a, n), b in found.items())


def apply_rules(found: Sequence[tuple[int, int, str]], book: Book) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(licence, start, end) by the ordered rules, by place, and the identifiers that no rule took.

    A taken sentence stays where it is as a barrier: the sentences around it do not follow each other.
    """
    names: list[str | None] = [x[2] for x in found]
    there, out = set(names), []
    for name, sequence in book.rules:
        if not there.issuperset(sequence):
            continue
        n, i = len(sequence), 0
        while i + n <= len(names):
            if tuple(names[i : i + n]) == sequence:
                out.append((name, found[i][0], found[i + n - 1][1]))
                names[i : i + n] = [None] * n
                i += n
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], x[2], x[0])), [x for x in names if x is not None]


def scan_text(text: str, book: Book) -> tuple[list[tuple[str, int, int]], int, list[str]]:
    found = identify(text, book)
    out, free = apply_rules(found, book)
    if "SPDX-License-Identifier" in text:
        out = sorted([*out, *((m[1], *m.span()) for m in _SPDX.finditer(text))], key=lambda x: (x[1], x[2], x[0]))
    return out, len(found), free


def scan_licenses(docs: DataFrame, book: Book | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_sentences (known ones), licenses (distinct names, sorted, comma-joined), matches (name:start:end by place), unruled.

    Places are code points, end exclusive. Null and empty texts have none; repeated rows and null ids
    each give their own row; further columns are ignored. Known sentences and rules are shipped to the
    tasks and have to stay under BROADCAST_LIMIT_BYTES; they do not grow with the documents.
    """
    book = book or default_book()
    if sum(map(len, book.known)) > BROADCAST_LIMIT_BYTES:
        raise ValueError("too many known sentences to ship to every task")
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("licenses")
        for batch in sliced(batches):
            got = [scan_text(t or "", book) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for _, n, _ in got], pa.int64()), pa.array([",".join(sorted({x[0] for x in m})) for m, _, _ in got], pa.string()),
                pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in m) for m, _, _ in got], pa.string()), pa.array([",".join(f) for _, _, f in got], pa.string()),
            ], names=names)

    names = [id_col, "n_sentences", "licenses", "matches", "unruled"]
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_sentences long, licenses string, matches string, unruled string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
