"""Licence scans by sentence rules (operator 7).

Texts are cut into sentences (at line ends and after . ; : ! ? followed by white space), and each sentence is
normalised: A-Z in lower case, everything but letters and digits as one blank, notices of years and holders set
aside. Known licence sentences have identifiers; a document becomes the sequence of the identifiers it holds, with
their places. A rule is a sequence of identifiers that names a licence; it matches where its identifiers follow each
other in order, with at most GAP pieces between the end of one and the start of the next, bare numbers and pieces
without letters or digits not counted, known sentences counted as one piece. Of known sentences that begin at one place
the longest counts. Longer rules win over rules they contain.

The dictionary is a fixed table of this module (or a parameter), so that it is broadcast in the functions' closure;
nothing is shuffled. Whole texts are read.

Edge cases: null or empty text: no licence. Repeated sentences give repeated identifiers, and each rule is reported
once a document with its first place. Rows may repeat; each gets its own result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, licenses string, rules string, n_sentences long, first_sentence long"
#: Pieces of the text that may stand between neighbours of a rule.
GAP = 2

# Sentences of public licences and notices, and the rules over them.
SENTENCES = {
    "mit-name": "the mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-licensed": "licensed under the apache license version 2 0",
    "apache-2-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2-you-may-not": "you may not use this file except in compliance with the license",
    "apache-2-obtain": "you may obtain a copy of the license at",
    "apache-2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nd-4": "licensed under cc by nd 4 0",
    "cc0-1": "licensed under cc0 1 0",
    "public-domain": "this work is in the public domain",
    "all-rights": "all rights reserved",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "apache-2-title": "apache license version 2 0 january 2004",
    "apache-2-copyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "lgpl-21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-library-received": "you should have received a copy of the gnu lesser general public license along with this library",
    "lgpl-21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-received": "you should have received a copy of the gnu lesser general public license along with this program",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-received": "you should have received a copy of the gnu affero general public license along with this program",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-2-obtain-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-2-title": "mozilla public license version 2 0",
    "epl-2-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-title": "eclipse public license v 2 0",
    "epl-1-made": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-1-title": "eclipse public license v 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense-dedicate": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-4-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-4-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "spdx-bsd-2": "spdx license identifier bsd 2 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-gpl-2-only": "spdx license identifier gpl 2 0 only",
    "spdx-gpl-2": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl-3-only": "spdx license identifier gpl 3 0 only",
    "spdx-lgpl-21": "spdx license identifier lgpl 2 1 or later",
    "spdx-lgpl-3": "spdx license identifier lgpl 3 0 or later",
    "spdx-agpl-3": "spdx license identifier agpl 3 0 or later",
    "spdx-mpl-2": "spdx license identifier mpl 2 0",
    "spdx-epl-2": "spdx license identifier epl 2 0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-cc0": "spdx license identifier cc0 1 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache-2": "spdx license identifier apache 2 0",
    "spdx-gpl-3": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd-3": "spdx license identifier bsd 3 clause",
}
RULES = (
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is")),
    ("mit-grant-only", "MIT", ("mit-grant",)),
    ("mit-name", "MIT", ("mit-name",)),
    ("mit-released", "MIT", ("mit-released",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("apache-2-header", "Apache-2.0", ("apache-2-the-license", "apache-2-you-may-not", "apache-2-obtain", "apache-2-unless")),
    ("apache-2-the-license", "Apache-2.0", ("apache-2-the-license",)),
    ("apache-2-licensed", "Apache-2.0", ("apache-2-licensed",)),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-received")),
    ("gpl-3-free", "GPL-3.0-or-later", ("gpl-free",)),
    ("gpl-3-work", "GPL-3.0", ("gpl-3-work",)),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("isc-text", "ISC", ("isc-grant",)),
    ("mpl-2-notice", "MPL-2.0", ("mpl-2-subject",)),
    ("cc-by-4", "CC-BY-4.0", ("cc-by-4",)),
    ("cc-by-sa-4", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("cc-by-nd-4", "CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("cc0-1", "CC0-1.0", ("cc0-1",)),
    ("public-domain", "Public-Domain", ("public-domain",)),
    ("all-rights", "Proprietary", ("all-rights",)),
    ("bsd-3-full", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("bsd-2-full", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("isc-full", "ISC", ("isc-grant", "isc-disclaimer")),
    ("0bsd-full", "0BSD", ("0bsd-grant", "isc-disclaimer")),
    ("apache-2-title", "Apache-2.0", ("apache-2-title",)),
    ("apache-2-copyright", "Apache-2.0", ("apache-2-copyright",)),
    ("gpl-2-only", "GPL-2.0-only", ("gpl-2-only",)),
    ("gpl-2-only-header", "GPL-2.0-only", ("gpl-2-only", "gpl-hope", "gpl-received")),
    ("gpl-2-free", "GPL-2.0-or-later", ("gpl-2-free",)),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-received")),
    ("gpl-2-title", "GPL-2.0", ("gpl-2-title",)),
    ("gpl-3-title", "GPL-3.0", ("gpl-3-title",)),
    ("lgpl-21-free", "LGPL-2.1-or-later", ("lgpl-21-free",)),
    ("lgpl-21-header", "LGPL-2.1-or-later", ("lgpl-21-free", "lgpl-hope", "lgpl-library-received")),
    ("lgpl-21-title", "LGPL-2.1", ("lgpl-21-title",)),
    ("lgpl-3-free", "LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-received")),
    ("lgpl-3-title", "LGPL-3.0", ("lgpl-3-title",)),
    ("agpl-3-free", "AGPL-3.0-or-later", ("agpl-3-free",)),
    ("agpl-3-header", "AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-received")),
    ("agpl-3-title", "AGPL-3.0", ("agpl-3-title",)),
    ("mpl-2-header", "MPL-2.0", ("mpl-2-subject", "mpl-2-obtain")),
    ("mpl-2-header-http", "MPL-2.0", ("mpl-2-subject", "mpl-2-obtain-http")),
    ("mpl-2-title", "MPL-2.0", ("mpl-2-title",)),
    ("epl-2-made", "EPL-2.0", ("epl-2-made",)),
    ("epl-2-title", "EPL-2.0", ("epl-2-title",)),
    ("epl-1-made", "EPL-1.0", ("epl-1-made",)),
    ("epl-1-title", "EPL-1.0", ("epl-1-title",)),
    ("unlicense-free", "Unlicense", ("unlicense-free",)),
    ("unlicense-text", "Unlicense", ("unlicense-free", "unlicense-anyone", "unlicense-dedicate")),
    ("cc-by-4-work", "CC-BY-4.0", ("cc-by-4-work",)),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("cc-by-nd-4-work", "CC-BY-ND-4.0", ("cc-by-nd-4-work",)),
    ("cc-by-nc-sa-4-work", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-work",)),
    ("cc-by-nc-nd-4-work", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-work",)),
    ("spdx-bsd-2", "BSD-2-Clause", ("spdx-bsd-2",)),
    ("spdx-isc", "ISC", ("spdx-isc",)),
    ("spdx-gpl-2-only", "GPL-2.0-only", ("spdx-gpl-2-only",)),
    ("spdx-gpl-2", "GPL-2.0-or-later", ("spdx-gpl-2",)),
    ("spdx-gpl-3-only", "GPL-3.0-only", ("spdx-gpl-3-only",)),
    ("spdx-lgpl-21", "LGPL-2.1-or-later", ("spdx-lgpl-21",)),
    ("spdx-lgpl-3", "LGPL-3.0-or-later", ("spdx-lgpl-3",)),
    ("spdx-agpl-3", "AGPL-3.0-or-later", ("spdx-agpl-3",)),
    ("spdx-mpl-2", "MPL-2.0", ("spdx-mpl-2",)),
    ("spdx-epl-2", "EPL-2.0", ("spdx-epl-2",)),
    ("spdx-unlicense", "Unlicense", ("spdx-unlicense",)),
    ("spdx-cc0", "CC0-1.0", ("spdx-cc0",)),
    ("spdx-mit", "MIT", ("spdx-mit",)),
    ("spdx-apache-2", "Apache-2.0", ("spdx-apache-2",)),
    ("spdx-gpl-3", "GPL-3.0-or-later", ("spdx-gpl-3",)),
    ("spdx-bsd-3", "BSD-3-Clause", ("spdx-bsd-3",)),
)

_SENTENCE = re.compile(r"\n+|(?<=[.;:!?])[^\S\n]+")
_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_NOTICE = re.compile(r"^(?:copyright )?(?:\(c\)|©|copyright)\s.*$", re.I)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def normalize(sentence: str) -> str:
    """Letters and digits with single blanks between; a copyright notice is empty."""
    if _NOTICE.match(sentence.strip()):
        return ""
    return plain(sentence)


def plain(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


class Scanner:
    def __init__(self, known: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = GAP):
        self.ids = {normalize(s): k for k, s in known.items()}
        # all its words begin with one of these, or no sentence is looked up: most lines of a corpus end here
        self.heads = {s.split(" ", 1)[0] for s in self.ids}
        # a sentence wrapped over lines is joined for as long as words of a longer known one may follow
        self.open = {s[: m.start()] for s in self.ids for m in re.finditer(" ", s)}
        self.rules, self.gap = sorted(rules, key=lambda r: -len(r[2])), gap

    def identifiers(self, text: str) -> tuple[list[str], list[tuple[int, int, str]]]:
        """The pieces, and (first piece, last piece, identifier) of the known sentences; wrapped ones are joined again, and of
        several that begin at one piece the longest counts."""
        parts = sentences(text)
        found = []
        for i, s in enumerate(parts):
            word = _WORD.search(s)
            if not word or _OTHER.split(word[0].lower(), maxsplit=1)[0] not in self.heads:
                continue
            n, whole = normalize(s), None
            if n in self.ids:
                whole = (i, i, self.ids[n])
            last = i
            while n in self.open and last + 1 < len(parts):
                last += 1
                joined = f"{n} {plain(parts[last])}".rstrip()
                # a wrapped line may begin with "copyright notice" and be part of the sentence
                if joined not in self.open and joined not in self.ids and not normalize(parts[last]):
                    continue
                if joined != n and joined in self.ids:
                    whole = (i, last, self.ids[joined])
                n = joined
            if whole:
                found.append(whole)
        return parts, found

    def matches(self, parts: list[str], found: list[tuple[int, int, str]]) -> list[tuple[int, str, str]]:
        """(place, rule, licence) of the rules that match, each once, without those inside a longer match."""
        counts = [bool(n) and not n.replace(" ", "").isdigit() for n in map(normalize, parts[found[0][0] : found[-1][0]])]
        base = found[0][0]
        # a known sentence is one piece, however it is wrapped
        for a, b, _ in found:
            for k in range(a + 1 - base, min(b + 1 - base, len(counts))):
                counts[k] = False
        before = list(accumulate(counts, initial=0))
        out, taken = [], set()
        for name, licence, ids in self.rules:
            first = None
            for start, (_, _, key) in enumerate(found):
                if key != ids[0]:
                    continue
                used = [start]
                for want in ids[1:]:
                    end, at = found[used[-1]][1] + 1 - base, None
                    for j in range(used[-1] + 1, len(found)):
                        place = found[j][0] - base
                        if place < end:
                            continue
                        if before[place] - before[end] > self.gap:
                            break
                        if found[j][2] == want:
                            at = j
                            break
                    if at is None:
                        break
                    used.append(at)
                if len(used) == len(ids) and not taken.issuperset(used):
                    taken.update(used)
                    first = found[start][0] if first is None else first
            if first is not None:
                out.append((first, name, licence))
        return sorted(out)

    def scan(self, text: str) -> tuple[str, str, int, int | None]:
        parts, found = self.identifiers(text)
        got = self.matches(parts, found) if found else []
        return ",".join(sorted({x for _, _, x in got})), ",".join(r for _, r, _ in got), len(parts), got[0][0] if got else None


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Per row: doc_id, licenses and rules (joined by commas), n_sentences, first_sentence (from 0; null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, rules)
        for b in batches:
            rows = [scanner.scan("" if t is None else t) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "licenses", "rules", "n_sentences", "first_sentence"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
