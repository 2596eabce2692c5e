"""License scans by sentence rules.

Whole texts are cut into sentences, sentences are normalised (lower case,
letters and digits only) and looked up among known licence sentences.  A known
sentence may be wrapped over any number of lines, comment marks before them.  The
identifiers found, in order, are matched against ordered rules: a rule matches
where its identifiers follow each other with at most MAX_GAP other sentences
between neighbours.  Rules of a full text come before rules of a short notice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Other sentences allowed between two neighbouring identifiers of a rule.
MAX_GAP = 3

#: Identifier, licence sentence.
SENTENCES = (
    ("mit-name", "MIT License"),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "as-is",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-use", "You may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (
        "apache-basis",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3-notice", "Licensed under the GNU General Public License, version 3."),
    (
        "gpl-free",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    (
        "gpl-2-free",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    (
        "lgpl-2-free",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    (
        "lgpl-3-free",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    (
        "agpl-3-free",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    (
        "gpl-hope",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    (
        "gpl-hope",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (
        "bsd-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    (
        "bsd-endorse",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    (
        "isc-as-is",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    (
        "zlib-grant",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    (
        "bsl-grant",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    (
        "epl-2-notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    ("cc-by-nc-4-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4-notice", "Licensed under CC BY-SA 4.0."),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
)

#: Licence, class of use, identifiers in order.  The first rule
#: of a licence that matches stands for it.
RULES = (
    ("MIT", "permissive", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", "permissive", ("mit-grant", "as-is")),
    ("Apache-2.0", "permissive", ("apache-notice", "apache-copy", "apache-basis")),
    ("Apache-2.0", "permissive", ("apache-notice", "apache-use", "apache-copy", "apache-basis")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-2-free", "gpl-hope")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-2-free", "gpl-hope")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl-3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-3-free", "gpl-hope")),
    ("ISC", "permissive", ("isc-grant", "isc-as-is")),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", "permissive", ("bsl-grant",)),
    ("EPL-2.0", "copyleft", ("epl-2-notice",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", "permissive", ("mit-notice",)),
    ("Apache-2.0", "permissive", ("apache-notice",)),
    ("GPL-3.0-only", "copyleft", ("gpl-3-notice",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4-notice",)),
    ("CC0-1.0", "public domain", ("cc0-notice",)),
    ("MPL-2.0", "copyleft", ("mpl-notice",)),
    ("Unlicense", "public domain", ("unlicense-notice",)),
)

def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentences and their identifiers."""
    return {normalised(sentence): name for name, sentence in SENTENCES}


def sentences(text: Column) -> Column:
    """The sentences of a text, in order; a full stop, exclamation or question
    mark before a blank ends one, and so does a line end."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\n"), "\n")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, found (array of (at, id): sentence numbers and
    identifiers) and licenses (array of (license, use), in order of the rules).

    Null and empty texts have no sentences; sentences without letters or
    digits are not counted.  Rows are handled one by one, so repeated rows give
    repeated results and nothing is shuffled.  Other columns are ignored.
    """
    table = known()
    parts = F.filter(sentences(F.col("text")), lambda s: s.rlike("[A-Za-z0-9]"))
    # Only texts with a word that every licence sentence has are normalised further.
    likely = F.lower("text").rlike("licen|permi|permission|software|warrant|copyright|redistribut|useful|rights|apache|public domain")
    # Pieces as lines "<number>words"; a known sentence is one piece or several that follow each other.
    numbered = F.transform("parts", lambda s, i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"), F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))))
    lines = F.when(likely, F.concat(F.lit("\n"), F.array_join(numbered, "\n"), F.lit("\n")))
    # Shortest first, so that sentences known on their own are found on their own.
    whole = "|".join(norm.replace(" ", r"(?: |\n<\d+>(?:rem |dnl )?)") for norm in sorted(table, key=len))
    matches = F.coalesce(F.regexp_extract_all("lines", F.lit(rf"<\d+>(?:rem |dnl )?(?:{whole})(?=\n)"), 0), F.array().cast("array<string>"))
    number = lambda m, pattern: F.regexp_extract(m, pattern, 1).cast("int")
    plain = lambda m: F.regexp_replace(F.regexp_replace(m, r"^<\d+>(?:rem |dnl )?", ""), r"\n<\d+>(?:rem |dnl )?", " ")
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    rows = docs.select("doc_id", "text", parts.alias("parts")).select("doc_id", F.size("parts").cast("long").alias("n_sentences"), lines.alias("lines"))
    rows = rows.select("doc_id", "n_sentences", matches.alias("matches"))
    spans = F.transform("matches", lambda m: F.struct(number(m, r"^<(\d+)>").alias("at"), number(m, r"(?s).*<(\d+)>").alias("end"), names[plain(m)].alias("id")))
    rows = rows.select("doc_id", "n_sentences", spans.alias("spans"))
    found = F.transform("spans", lambda x: F.struct(x["at"].alias("at"), x["id"].alias("id")))
    rows = rows.select("doc_id", "n_sentences", "spans", found.alias("found"))
    # One string of identifiers; neighbours too far apart have "|" between them.
    start = F.struct(F.lit(-1000000).alias("at"), F.lit(">").alias("s"))
    step = lambda acc, x: F.struct(
        x["end"].alias("at"),
        F.concat(acc["s"], F.when(x["at"] - acc["at"] > MAX_GAP + 1, F.lit("|>")).otherwise(F.lit("")), x["id"], F.lit(">")).alias("s")
    )
    text = F.aggregate("spans", start, step, lambda acc: acc["s"])
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col("_ids").contains(">" + ">".join(ids) + ">"), F.struct(F.lit(name).alias("license"), F.lit(use).alias("use"))) for name,
                use, ids in RULES
            ]
        )
    )
    return rows.withColumn("_ids", text).select("doc_id", "n_sentences", "found", F.array_distinct(hits).alias("licenses"))
