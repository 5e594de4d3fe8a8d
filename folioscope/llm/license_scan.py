"""License scans (8): sentence-rule recognition.

A text is cut into sentences, each normalised to its lower-cased letters and digits and looked up
among the sentences of known licences; what is known becomes an identifier. The sequence of
identifiers, with their places, is matched against ordered rules: a rule fits if its sentences follow
one another with at most ``GAP`` other sentences between. Every choice of sentences is considered
(from the last sentence of a rule to its first, each keeps the earliest end that can be reached), so a
match is found wherever there is one: one for each place at which the rule can begin, the shortest. A rule
inside a longer one that fits is not reported beside it. An SPDX-License-Identifier line names its licences itself.

Sentences are cut twice, at sentence ends with line breaks as spaces (wrapped licence texts) and at
line breaks too (a notice under an unfinished line); what either cut recognises counts once.

Defined cases: null, empty and blank texts have no sentences; repeated notices count as one licence
with several matches; of rules of the same places those of most sentences are reported, all of them; very long texts, sentences
and runs of white space take time in proportion to their length; repeated rows are scanned once each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fail_unless, small_batches

GAP = 1
# The wording of public licences and of customary notices.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
RULES: dict[str, list[tuple[str, ...]]] = {
    "Apache-2.0": [
        ("Licensed under the Apache License, Version 2.0.",),
        (
            '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
            '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
        ),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "You may obtain a copy of the License at",
            "http://www.apache.org/licenses/LICENSE-2.0",
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
            "See the License for the specific language governing permissions and limitations under the License.",
        ),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "You may obtain a copy of the License at",
        ),
    ],
    "AGPL-3.0": [
        ("This work is licensed under the GNU Affero General Public License, version 3.",),
        ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    ],
    "LGPL-2.1": [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    ],
    "LGPL-3.0": [
        ("This work is licensed under the GNU Lesser General Public License, version 3.",),
        ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
        ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    ],
    "GPL-2.0": [
        ("This work is licensed under the GNU General Public License, version 2.",),
        (
            "The licenses for most software are designed to take away your freedom to share and change it.",
            "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        ),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",),
    ],
    "MPL-2.0": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ),
        ("Licensed under the Mozilla Public License, Version 2.0.",),
        ("Licensed under the Mozilla Public License 2.0.",),
    ],
    "Unlicense": [
        ("This is free and unencumbered software released into the public domain.",),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
            "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
            "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
            "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ],
    "CC0-1.0": [
        ("Licensed under CC0 1.0.",),
        ("This work is licensed under CC0 1.0.",),
        ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",),
    ],
    "MIT": [
        ("Released under the MIT License.",),
        ("Licensed under the MIT License.",),
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ),
        (f"{_MIT_GRANT}, subject to the following conditions:", _MIT_NOTICE, *_MIT_DISCLAIMER),
    ],
    "MIT-0": [(f"{_MIT_GRANT}.", *_MIT_DISCLAIMER)],
    "Zlib": [
        (
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
            "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
            "This notice may not be removed or altered from any source distribution.",
        ),
    ],
    "BSL-1.0": [
        ("Distributed under the Boost Software License, Version 1.0.",),
        ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',),
    ],
    "WTFPL": [("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)],
    "EPL-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)],
    "GPL-3.0": [
        ("This work is licensed under the GNU General Public License, version 3.",),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
        (
            "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
            "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
        ),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ),
    ],
    "CC-BY-NC-4.0": [("Licensed under CC BY-NC 4.0.",)],
    "CC-BY-4.0": [("Licensed under CC BY 4.0.",), ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)],
    "CC-BY-SA-4.0": [("Licensed under CC BY-SA 4.0.",)],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",), (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", *_ISC_DISCLAIMER)],
    "0BSD": [(f"{_ISC_GRANT}.", *_ISC_DISCLAIMER)],
    "BSD-2-Clause": [_BSD[:2], _BSD, (*_BSD, *_BSD_DISCLAIMER)],
    "BSD-3-Clause": [
        ("Licensed under the BSD 3-Clause License.",),
        (*_BSD, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        (*_BSD, _BSD_ENDORSE, *_BSD_DISCLAIMER),
        # a holder's name with a full stop cuts the sentence in two
        (*_BSD, "Neither the name of X Inc.", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ],
}
#: identifiers of SPDX lines and the names that they are reported by
SPDX = {n.lower(): n for n in RULES} | {f"{n.lower()}{end}": n for n in RULES if "GPL" in n for end in ("-only", "-or-later", "+")}
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)
_WRAPPED = re.compile(rb"(?<=[.!?:;])\s+|\n\s*\n\s*")
_LINES = re.compile(rb"(?<=[.!?:;])\s+|\n\s*")


_SPDX_LINE = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
_SPDX_NAME = re.compile(rb"(?<![A-Za-z0-9.+-])[A-Za-z0-9][A-Za-z0-9.+-]*")
#: the holder in the endorsement clause
_HOLDER = re.compile(rb"neither the names? of .+?(?= (?:n?or) the names of its contributors |$)")


def normalised(sentence: bytes) -> bytes:
    form = b" ".join(sentence.translate(_SIGNS).split())
    return _HOLDER.sub(b"neither the name of x", form, count=1) if form.startswith(b"neither the name") else form


def spdx(text: bytes) -> Iterator[tuple[str, int, int]]:
    """(licence, start, end) for the known identifiers of SPDX lines; unknown ones and exceptions are passed over."""
    if b"SPDX-License-Identifier:" in text:
        for line in _SPDX_LINE.finditer(text):
            for m in _SPDX_NAME.finditer(text, line.start(1), line.end(1)):
                if name := SPDX.get(m[0].decode().lower()):
                    yield name, m.start(), m.end()


def sentences(text: bytes, cut: re.Pattern) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and normal form of each sentence."""
    start = 0
    for end, following in [*((m.start(), m.end()) for m in cut.finditer(text)), (len(text), len(text))]:
        sentence = text[start:end].rstrip()
        yield start, start + len(sentence), normalised(sentence)
        start = following


class Rules:
    """Sentence identifiers and the rules over them."""

    def __init__(self, rules: dict[str, list[tuple[str, ...]]], spdx: bool = True):
        self.spdx = spdx
        self.known: dict[bytes, int] = {}
        self.by_first: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for name, own in sorted(rules.items()):
            for rule in own:
                # a rule's sentence may itself hold cuts, as at a semicolon
                parts = [n for s in rule for _, _, n in sentences(s.encode(), _WRAPPED) if n]
                ids = tuple(self.known.setdefault(n, len(self.known)) for n in parts)
                self.by_first.setdefault(ids[0], []).append((name, ids))

    def recognised(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(number of the sentence, start, end, identifier), of either cut."""
        out = {}
        for cut in (_WRAPPED, _LINES):
            n = 0
            for start, end, form in sentences(text, cut):
                if form:
                    n += 1
                    if (known := self.known.get(form)) is not None:
                        out.setdefault((cut is _LINES, n), (n, start, end, known))
        return [(lines, *v) for (lines, _), v in sorted(out.items())]

    def ends(self, at: dict[int, tuple[int, int, int]], ids: tuple[int, ...]) -> dict[int, int]:
        """For the number of each sentence at which a rule can begin, that of the earliest one at which it can end.

        at: number -> (start, end, identifier) of the sentences that are known.
        """
        places: dict[int, list[int]] = {}
        for n, (_, _, known) in at.items():
            places.setdefault(known, []).append(n)
        best = {n: n for n in places.get(ids[-1], ())}
        for want in ids[-2::-1]:
            best = {n: min(after) for n in places.get(want, ()) if (after := [best[m] for m in range(n + 1, n + 2 + GAP) if m in best])}
        return best

    def matches(self, text: bytes) -> tuple[list[int], list[tuple[str, int, int]]]:
        """Identifiers in order of place, and (licence, start, end) of the rules that fit, longest ones only."""
        rows = self.recognised(text)
        found = set()
        for lines in (False, True):
            at = {n: (start, end, known) for cut, n, start, end, known in rows if cut is lines}
            for first in sorted({known for _, _, known in at.values()}):
                for name, ids in self.by_first.get(first, ()):
                    found.update((at[n][0], -at[m][1], -len(ids), name) for n, m in self.ends(at, ids).items())
        # by start, then the longer first: what an earlier one reaches beyond lies inside it
        kept, reach, place = [], -1, None
        for start, end, size, name in sorted(found):
            if (start, end, size) == place or -end > reach:
                kept.append((name, start, -end))
                reach, place = -end, (start, end, size)
        known_at = {(r[2], r[3]): r[4] for r in rows}
        kept += spdx(text) if self.spdx else ()
        return [v for _, v in sorted(known_at.items())], sorted(set(kept), key=lambda m: (m[1], m[2], m[0]))


def license_scan(documents: DataFrame, rules: dict[str, list[tuple[str, ...]]] | None = None) -> DataFrame:
    """Per document: doc_id, n_sentences known, n_matches, licenses (sorted names joined by commas), spans (byte places)."""
    fail_unless(("doc_id", "text"), documents, "documents")
    small_batches(documents.sparkSession)
    table = Rules(rules or RULES, spdx=not rules)
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = [own.matches(t) for t in batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
            columns = [
                batch.column(0), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([",".join(sorted({m[0] for m in r[1]})) for r in rows], pa.string()), pa.array([" ".join(f"{m[0]}:{m[1]}-{m[2]}" for m in r[1]) for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_matches", "licenses", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_sentences long, n_matches long, licenses string, spans string")
