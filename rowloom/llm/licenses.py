"""Licence scans: parts of a text compared to licence templates by the Dice coefficient of their word bigrams.

Of a text the part of highest coefficient is sought among all runs of words, so that a licence is found in the midst of other
text, across line breaks and with words put in.  The best part begins and ends with bigrams of the template, and its
first doesn't come again in it.  With ``need`` as the coefficient to reach, a part of a bigrams can match a template of b only if
need / (2 - need) * b <= a <= (2 - need) / need * b, and only if they share need / 2 * (a + b): what is out of
these bounds is pruned before it is compared.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rowloom.llm.common import filled, pieces, slices

NEED = 800  # of 1000

#: Licences, their notices and texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
    # whole texts, or the whole of a licence's standard header
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later."),
    ("Artistic-2.0", "This package is licensed under the Artistic License 2.0."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
)
EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def normal(word: str) -> str:
    """Lower case, without punctuation at its ends, in one spelling."""
    word = EDGES.sub("", word.lower())
    return "license" + word[7:] if word.startswith("licence") else word


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names = [n for n, _ in templates]
        texts = [[w for w in map(normal, t.split()) if w] for _, t in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.size = len(self.ids)
        self.sets = [{self.ids[a] * self.size + self.ids[b] for a, b in zip(t, t[1:])} for t in texts]
        if not all(self.sets):
            raise ValueError("a template has two words at least")
        self.known = np.zeros(self.size * self.size, bool)
        self.known[[g for s in self.sets for g in s]] = True


@functools.lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def fits(a: int, b: int, need: int) -> bool:
    """Whether sets of a and b can reach the coefficient, by their sizes."""
    return need * b <= (2000 - need) * a and need * a <= (2000 - need) * b


def scan(grams: np.ndarray, t: Templates, need: int) -> dict[str, int]:
    """Best coefficient by licence of any part of a text, in thousandths, of those that reach ``need``.

    ``grams`` are a text's bigrams, those of no template negative.
    """
    hits = np.flatnonzero(grams >= 0)
    best: dict[str, int] = {}
    if not len(hits):
        return best
    values = grams[hits].tolist()
    every: list[int] = []
    for name, own in zip(t.names, t.sets):
        b = len(own)
        least = -(-need * b // (2000 - need))  # shared ones without which no part reaches the coefficient
        mine = [k for k, g in enumerate(values) if g in own]
        if len({values[k] for k in mine}) < least:
            continue
        if not every:
            every = grams.tolist()
            new = np.zeros(len(grams), bool)
            new[np.unique(grams, return_index=True)[1]] = True
            other = np.cumsum(new & (grams < 0))[hits]  # different bigrams of no template before each hit
        # of a part from a hit on with the least shared ones, no fewer other bigrams than come up first in it
        apart = other[mine[least - 1 :]] - other[mine[: len(mine) - least + 1]]
        again: dict[int, int] = {}
        stops = {}  # where a hit's bigram comes again: a part from there on is no worse
        for k in reversed(mine):
            stops[k] = again.get(values[k], len(grams))
            again[values[k]] = int(hits[k])
        for k in np.array(mine)[np.flatnonzero(need * (apart + least) <= (2000 - need) * b)].tolist():
            seen: set[int] = set()
            shared = 0
            for at in range(hits[k], stops[k]):
                g = every[at]
                if g in seen:
                    continue
                seen.add(g)
                a = len(seen)
                if need * a > (2000 - need) * b:
                    break
                if g in own:
                    shared += 1
                    if fits(a, b, need) and 2000 * shared >= need * (a + b):
                        best[name] = max(best.get(name, 0), 2000 * shared // (a + b))
    return best


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, need: int = NEED) -> DataFrame:
    """Key, ``license`` (the best, ties by name), ``dice`` in thousandths, and ``licenses`` (all, by name) of every document.

    Without a match license is null, dice 0 and licenses ''.  null and empty texts match nothing.  Very long
    texts are taken whole.  Repeated rows give a row each; a null key is kept.  Other columns aren't read.
    Empty table: empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        t = prepared(templates)
        for part in slices(batches):
            texts = filled(part)
            off, words = pieces(pc.ascii_split_whitespace(texts))
            coded = words.dictionary_encode()
            forms = [normal(w) for w in coded.dictionary.to_pylist()]
            codes = t.ids | {f: t.size + i for i, f in enumerate(sorted({*forms} - {*t.ids, ""}))}
            ids = np.array([codes.get(f, -1) for f in forms], np.int64)
            word = ids[coded.indices.to_numpy(zero_copy_only=False)]
            found = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                w = word[a:b]
                w = w[w >= 0]
                plain = w < t.size
                if plain.sum() < 2:
                    found.append({})
                    continue
                known = np.flatnonzero(plain[:-1] & plain[1:])
                known = known[t.known[w[known] * t.size + w[known + 1]]]
                if not len(known):
                    found.append({})
                    continue
                grams = -1 - (w[:-1] * len(codes) + w[1:])
                grams[known] = w[known] * t.size + w[known + 1]
                found.append(scan(grams, t, need))
            best = [min(f, key=lambda n: (-f[n], n)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(best, pa.string()), pa.array([f[n] if f else 0 for f, n in zip(found, best)], pa.int64()), pa.array([",".join(sorted(f)) for f in found], pa.string())], [key, "license", "dice", "licenses"])

    return docs.select(key, docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, license string, dice bigint, licenses string")
