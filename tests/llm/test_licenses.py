"""Licence sentences and rules, by cases and against plain Python."""

import random
import re

from tessera.llm import licenses as l

SCHEMA = "doc_id long, text string, licenses string"


def plain(text):
    ids = [l.SENTENCES[n] for s in re.split(l.ENDS.replace("$", r"\Z"), text or "") if (n := re.sub("[^a-z0-9]+", " ", s.lower()).strip()) in l.SENTENCES]
    left, found = "".join(f"<{i}>" for i in ids), []
    for sequence, name in l.RULES:
        if re.search(l._rule(sequence), left) and name not in found:
            found.append(name)
        left = re.sub(l._rule(sequence), "", left)
    return ",".join(ids), ",".join(found), left.count("<")


def test_cases(spark):
    texts = [
        None,
        "",
        "no licence here",
        "Intro text.\nReleased under the MIT License.\nMore.",
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You may obtain a copy of the License at: nowhere",
        "All rights reserved! The MIT License\n" * 3,
        "x " * 50000 + "\nReleased under the MIT License",
    ]
    want = ["", "", "", "MIT", "Apache-2.0,CC-BY-NC-4.0", "GPL-3.0-only", "", "MIT,Proprietary", "MIT"]
    docs = spark.createDataFrame([(i if i else None, t, "own") for i, t in enumerate([*texts, texts[3]])], SCHEMA)
    out = {r.doc_id or 0: r for r in l.license_scan(docs).collect()}
    assert [out[i].licenses for i in range(len(texts))] == want and out[9].licenses == "MIT" and out[6].unmatched == 1
    assert l.license_scan(docs.limit(0)).count() == 0


def test_against_plain_python(spark):
    rng = random.Random(3)
    known = list(l.SENTENCES)
    texts = []
    for _ in range(150):
        parts = [rng.choice(known).upper() if rng.random() < 0.3 else rng.choice(known) if rng.random() < 0.7 else "other words" for _ in range(rng.randint(0, 7))]
        texts.append("".join(p + rng.choice([". ", "\n", "! ", ".\n", "; "]) for p in parts))
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], SCHEMA)
    for r in l.license_scan(docs).collect():
        assert (r.sentence_ids, r.licenses, r.unmatched) == plain(texts[r.doc_id])


def test_sentences_over_lines(spark):
    bsd = [
        "Redistributions of source code must retain the above copyright notice, this",
        "list of conditions and the following disclaimer.",
        "",
        "2. Redistributions in binary form must reproduce the above copyright",
        "   notice, this list of conditions and the following disclaimer in the",
        "   documentation and/or other materials provided with the distribution.",
    ]
    mit = "MIT License\r\n\r\nCopyright (c) 2020\n\nThe above copyright notice and this permission\nnotice shall be included in all copies or substantial portions of the Software.\n"
    texts = ["\n".join(bsd), "\n".join(f" * {x}" + " " * 300 + "*" for x in bsd), mit, "released under\n\nthe mit\n\nlicense", "Released under the" + " " * 500 + "MIT License", "given under the\nMIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.licenses for r in l.license_scan(docs).collect()}
    assert [out[i] for i in range(len(texts))] == ["BSD-2-Clause", "BSD-2-Clause", "MIT", "", "MIT", ""]


HEADERS = {
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
}


def test_headers_as_files_have_them(spark):
    docs = spark.createDataFrame(list(enumerate(HEADERS.values())), "doc_id long, text string")
    out = {r.doc_id: r for r in l.license_scan(docs).collect()}
    assert [out[i].licenses for i in range(len(HEADERS))] == list(HEADERS)
    assert all(r.unmatched == 0 for r in out.values())
    assert all(re.search(l.KEYS, s) for s in l.SENTENCES)
