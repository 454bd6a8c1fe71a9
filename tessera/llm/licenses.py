"""Licences by recognised sentences.

Texts are normalised, with breaks at sentence marks and at lines, and known licence sentences are found
between breaks; a sentence may go over lines, not over a mark or a blank line. The sequence of their
identifiers is matched against ordered rules; a rule takes the identifiers that it matches. Column
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import packed, unpacked

#: Known sentences, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheGrant",
    "licensed under the apache license version 2 0 the license": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MITGrant",
    "licensed under the mit license": "MITGrant",
    "this project is licensed under the mit license": "MITGrant",
    "the mit license": "MITTitle",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "this work is licensed under the gnu general public license version 3": "GPL3Grant",
    "licensed under the gnu general public license version 3": "GPL3Grant",
    "this program is free software": "GPLFree",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "licensed under cc by nc 4 0": "CCBYNC4Grant",
    "licensed under cc by 4 0": "CCBY4Grant",
    "licensed under cc by sa 4 0": "CCBYSA4Grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "all rights reserved": "AllRights",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITPermission",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this source code form is subject to the terms of the mozilla public license v": "MPLGrant",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPLCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPLCopy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2Grant",
    "this library is free software": "GPLFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3OrLater",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3OrLater",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3OrLater",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLTerms",
    "either version 2 of the license or at your option any later version": "Version2OrLater",
    "either version 2 1 of the license or at your option any later version": "Version21OrLater",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLHope",
    "this library is distributed in the hope that it will be useful but without any warranty": "GPLHope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLDetails",
    "see the gnu lesser general public license for more details": "GPLDetails",
    "see the gnu affero general public license for more details": "GPLDetails",
    "you should have received a copy of the gnu lesser general public license along with this library": "GPLCopy",
    "you should have received a copy of the gnu affero general public license along with this program": "GPLCopy",
}

#: What may follow a grant of the GNU licences.
_GNU = ("GPLHope?", "GPLWarranty?", "GPLDetails?", "GPLCopy?")

#: Ordered rules: a sequence of identifiers (? after one that may lack), and the licence.
RULES = (
    (("BSDSource", "BSDBinary", "BSDEndorse"), "BSD-3-Clause"),
    (("BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("GPLFree?", "AGPL3OrLater", *_GNU), "AGPL-3.0-or-later"),
    (("GPLFree?", "LGPL3OrLater", *_GNU), "LGPL-3.0-or-later"),
    (("GPLFree?", "GPL3OrLater", *_GNU), "GPL-3.0-or-later"),
    (("GPLFree?", "LGPLTerms", "Version21OrLater", *_GNU), "LGPL-2.1-or-later"),
    (("GPLFree?", "GPLTerms", "Version2OrLater", *_GNU), "GPL-2.0-or-later"),
    (("MITTitle?", "MITPermission", "MITNotice?"), "MIT"),
    (("MITTitle?", "MITGrant", "MITNotice?"), "MIT"),
    (("MITTitle", "MITNotice?"), "MIT"),
    (("ApacheGrant", "ApacheUse?", "ApacheCopy?", "ApacheAsIs?", "ApacheSee?"), "Apache-2.0"),
    (("ISCGrant",), "ISC"),
    (("ZlibGrant",), "Zlib"),
    (("Unlicense",), "Unlicense"),
    (("MPLGrant", "MPLCopy?"), "MPL-2.0"),
    (("EPL2Grant",), "EPL-2.0"),
    (("GPLFree?", "GPL3Grant", "GPLCopy?"), "GPL-3.0-only"),
    (("GPLFree", "GPLCopy?"), "GPL-unspecified"),
    (("CCBYNC4Grant",), "CC-BY-NC-4.0"),
    (("CCBYSA4Grant",), "CC-BY-SA-4.0"),
    (("CCBY4Grant",), "CC-BY-4.0"),
    (("AllRights",), "Proprietary"),
)

#: Every known sentence has one of these; texts without any are not looked at further.
KEYS = "licen|copyright|software|redistribution|reserved|warranty|mozilla"

#: A title is a known one where it begins a paragraph.
TITLES = {"mit license": "MITTitle"}

#: Where sentences end: a mark before white space or the end, or a line's end.
ENDS = r"[.!?;:][\x20\x09-\x0D]+|[.!?;:]$|\n"


def _rule(sequence: tuple[str, ...]) -> str:
    return "".join(f"(<{x[:-1]}>)?" if x.endswith("?") else f"<{x}>" for x in sequence)


def _normalised(text: Column) -> Column:
    """Words by single blanks; a line feed where a line ends, two or more where a mark or a blank line (of decoration, too) is."""
    marked = F.regexp_replace(F.lower(text), r"[.!?;:][\x20\x09-\x0D]+", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9\n]+", " "), " ?\n ?", "\n"))


def _known() -> str:
    """Known sentences between breaks, the longest first; a line may end at any blank of them."""
    wrapped = lambda names: "|".join(n.replace(" ", "[ \n]") for n in sorted(names, key=lambda n: (-len(n), n)))
    return f"(?<![^\n])(?:{wrapped(SENTENCES)})(?![^\n])|(?<![^\n])(?<![^\n]\n)(?:{wrapped(TITLES)})(?![^\n])"


#: Columns that the operator adds; columns of the input with these names are replaced.
ADDED = ("sentence_ids", "licenses", "unmatched")


def license_scan(docs: DataFrame) -> DataFrame:
    """Every row of docs without text, with ADDED.

    sentence_ids are the identifiers of known sentences in their order, by commas; licenses those of the
    rules that match, each once, in the order of the rules; unmatched the number of identifiers that no
    rule took. Null and empty texts have no identifiers. Repeated rows give equal results, an empty table none.
    """
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | TITLES).items() for x in pair])
    names = [c for c in docs.columns if c != "text" and c not in ADDED]
    plain = packed(docs, "text", without=("text", *ADDED))
    text = F.when(F.lower("text").rlike(KEYS), F.col("text")).otherwise("")
    found = F.regexp_extract_all(_normalised(text), F.lit(_known()), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    df = plain.withColumn("_ids", ids).drop("text")
    df = df.withColumn("_left", F.concat(F.lit(""), F.array_join(F.transform("_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")))
    found = []
    for k, (sequence, name) in enumerate(RULES):
        df = df.withColumn(f"_r{k}", F.when(F.col("_left").rlike(_rule(sequence)), F.lit(name)))
        df = df.withColumn("_left", F.regexp_replace("_left", _rule(sequence), ""))
        found.append(F.col(f"_r{k}"))
    named = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",")
    left = F.length("_left") - F.length(F.replace(F.col("_left"), F.lit("<"), F.lit("")))
    return unpacked(df, names, F.array_join("_ids", ",").alias("sentence_ids"), named.alias("licenses"), left.cast("long").alias("unmatched"))


def oracle_sql() -> str:
    """The same over documents, as DuckDB text."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps = [
        ("s0", r"SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS s FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?;:][\x20\x09-\x0D]+|[.!?;:]$|\n') AS parts FROM documents)"),
        ("known(sentence, id)", f"VALUES {known}"),
        ("hit", "SELECT doc_id, k, id FROM s0 JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence"),
        ("seq", "SELECT doc_id, string_agg(id, ',' ORDER BY k) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY k) AS left0 FROM hit GROUP BY doc_id"),
        ("r0", "SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(left0, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM documents LEFT JOIN seq USING (doc_id)"),
    ]
    for k, (sequence, name) in enumerate(RULES):
        rx = _rule(sequence)
        steps.append((f"r{k + 1}", f"SELECT doc_id, sentence_ids, regexp_replace(rest, '{rx}', '', 'g') AS rest, CASE WHEN regexp_matches(rest, '{rx}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{k}"))
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in steps) + f" SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licenses, CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS unmatched FROM r{len(RULES)}"
