"""Licence scan by sentence rules, in DataFrame functions only.

Sentences of a text are normalised (lower case, runs of anything but a-z and 0-9
become one blank) and mapped to identifiers of known licence sentences.  The
identifiers of a text, one letter each and a dot for unknown sentences, are
matched against ordered rules: a rule is a sequence of identifiers that follow
each other, and an earlier rule wins over a later one at the same place.

A sentence ends at ``. ! ? ;`` before white space or at the end, and at an empty
line.  Texts are read twice, with and without every line break as an end, since licences are quoted both as
lines and as wrapped paragraphs; findings are united.  "All rights reserved" alone
or at the end of a copyright notice is a rule of its own (LicenseRef-proprietary),
but not at the head of a BSD text.

Defined results: null and empty texts have no sentence; equal rows are scanned
one by one; an empty table gives no rows; further columns are not looked at.  All
work is done within a row, so no text is shuffled and no group is hot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences by identifier, as published with the licences.
SENTENCES = {
    "A": "Licensed under the Apache License, Version 2.0",
    "B": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "C": "you may not use this file except in compliance with the License",
    "D": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "E": "Licensed under the GPL",
    "F": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "G": "See the License for the specific language governing permissions and limitations under the License",
    "H": "Released under the MIT License",
    "I": "Licensed under the MIT License",
    "J": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "K": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software",
    "L": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "M": "This work is licensed under the GNU General Public License, version 3",
    "N": "This work is licensed under the GNU General Public License, version 2",
    "O": "This program is free software",
    "P": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version",
    "Q": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation",
    "a": "either version 2 of the License, or (at your option) any later version",
    "R": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "S": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "T": "Licensed under CC BY-NC 4.0",
    "U": "Licensed under CC BY 4.0",
    "V": "Licensed under CC BY-SA 4.0",
    "W": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "X": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "Y": "SPDX-License-Identifier: MIT",
    "Z": "SPDX-License-Identifier: Apache-2.0",
    "g": "All rights reserved",
    "b": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer",
    "c": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution",
    "d": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission",
    "e": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "f": "This library is free software",
    "h": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation",
    "i": "either version 2.1 of the License, or (at your option) any later version",
    "j": "either version 3 of the License, or (at your option) any later version",
    "k": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version",
    "l": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version",
    "m": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "n": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "o": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "p": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted",
    "q": "This is free and unencumbered software released into the public domain",
    "r": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to "
    "this software to the public domain worldwide",
    "s": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "t": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}

# Rules in their order, name and sequence of sentence identifiers.
RULES = [
    ("Apache-2.0", "BCDFG"),
    ("MIT", "JKL"),
    ("GPL-3.0-or-later", "PRS"),
    ("GPL-3.0-or-later", "P"),
    ("GPL-2.0-or-later", "OQaRS"),
    ("GPL-2.0-or-later", "OQa"),
    ("Apache-2.0", "BC"),
    ("Apache-2.0", "A"),
    ("Apache-2.0", "Z"),
    ("MIT", "H"),
    ("MIT", "I"),
    ("MIT", "J"),
    ("MIT", "Y"),
    ("GPL-3.0-only", "M"),
    ("GPL-2.0-only", "N"),
    ("CC-BY-NC-4.0", "T"),
    ("CC-BY-4.0", "U"),
    ("CC-BY-4.0", "W"),
    ("CC-BY-SA-4.0", "V"),
    ("BSD-4-Clause", "gXbced"),
    ("BSD-4-Clause", "Xbced"),
    ("BSD-4-Clause", "gXbce"),
    ("BSD-4-Clause", "Xbce"),
    ("BSD-3-Clause", "gXbcd"),
    ("BSD-3-Clause", "Xbcd"),
    ("BSD-2-Clause", "gXbc"),
    ("BSD-2-Clause", "Xbc"),
    ("BSD", "gX"),
    ("BSD", "X"),
    ("GPL", "E"),
    ("LGPL-2.1-or-later", "fhi"),
    ("LGPL-3.0-or-later", "fhj"),
    ("LGPL-3.0-or-later", "Ohj"),
    ("LGPL-2.1-or-later", "Ohi"),
    ("LGPL-3.0-or-later", "k"),
    ("AGPL-3.0-or-later", "l"),
    ("MPL-2.0", "m"),
    ("ISC", "n"),
    ("ISC", "o"),
    ("0BSD", "p"),
    ("Unlicense", "q"),
    ("CC0-1.0", "r"),
    ("CC-BY-SA-4.0", "s"),
    ("CC-BY-NC-4.0", "t"),
    ("LicenseRef-proprietary", "g"),
]

# Licences by SPDX identifier, with the names that short statements use.  ``GPL-2.0`` and the like
# are the older identifiers, which normalise to the same words with and without a plus.
LICENCES = {
    "GPL-2.0-only": (),
    "GPL-2.0-or-later": (),
    "GPL-3.0-only": (),
    "GPL-3.0-or-later": (),
    "GPL-2.0": ("GPL v2", "GPLv2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPL v3", "GPLv3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-2.1-or-later": (),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "LGPL-3.0-or-later": (),
    "LGPL-2.1": ("LGPL v2.1", "LGPLv2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("LGPL v3", "LGPLv3", "GNU Lesser General Public License v3.0"),
    "LGPL": ("LGPL", "GNU LGPL", "GNU Lesser General Public License"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "AGPL-3.0-or-later": (),
    "AGPL-3.0": ("AGPL v3", "AGPLv3", "GNU Affero General Public License v3.0"),
    "AGPL": ("AGPL", "GNU AGPL", "GNU Affero General Public License"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "ISC": ("ISC License",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License"),
    "0BSD": (),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": (),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": (),
    "CC-BY-SA-4.0": (),
    "CC-BY-NC-4.0": (),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
STATEMENTS = ("Licensed under the", "Released under the", "This work is licensed under the", "Licensed under")


def _short_rows() -> None:
    """A sentence and a rule of one letter for every SPDX identifier and every short statement."""
    taken = set(map(normalised, SENTENCES.values()))
    letter = 0x100  # letters beyond Latin-1, as the ASCII ones would not do
    for name, titles in LICENCES.items():
        rows = [f"SPDX-License-Identifier: {name}"] if name not in ("LGPL", "AGPL", "BSD") else []
        for sentence in rows + [f"{how} {title}" for title in titles for how in STATEMENTS]:
            if normalised(sentence) not in taken:
                taken.add(normalised(sentence))
                SENTENCES[chr(letter)] = sentence
                RULES.append((name, chr(letter)))
                letter += 1


# Sentences with a part that varies, by the identifier of the sentence that they stand for: how a
# normalised one begins and ends, and the pattern of the whole.
FORMS = {
    "g": ("", " all rights reserved", "^(copyright|c [12][0-9]{3}|[12][0-9]{3}) (.* )?all rights reserved$"),
    "d": (
        "neither the name of ",
        " without specific prior written permission",
        "^neither the name of .* nor the names of (its|their|any) contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission$",
    ),
    "e": (
        "all advertising materials ",
        "",
        "^all advertising materials mentioning features or use of this software must display the following "
        "acknowledgement .*$",
    ),
}

END = "\x01"
# A number before a clause on a line of its own ("1. ", "2) ") belongs to the end before it.
ENDS_TEXT = r"[.!?;]+([ \t\r\f]*\n[ \t\n\r\f]*[0-9][0-9]?[.)][ \t]|[ \t\n\r\f]|$)|\n([ \t\n\r\f]*[0-9][0-9]?[.)][ \t]|[ \t\r\f]*\n)"
ENDS_LINE = r"[.!?;]*\n|[.!?;]+([ \t\r\f]|$)"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


_short_rows()


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {normalised(sentence): key for key, sentence in SENTENCES.items()}


def sentences(text: str, ends: str) -> Column:
    """Normalised sentences of the column ``text`` that are not empty."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cut = F.regexp_replace(low, ends, END)
    flat = F.regexp_replace(cut, f"[^a-z0-9{END}]+", " ")
    tight = F.regexp_replace(flat, f" ?{END}[ {END}]*", END)
    return F.filter(F.split(F.trim(tight), END), lambda s: s != "")


def identifiers(sents: Column) -> Column:
    """One letter per sentence, a dot for an unknown one."""
    known = known_sentences()
    words = F.array(*[F.lit(s) for s in known])
    letters = F.lit("." + "".join(known.values()))

    def letter(s: Column) -> Column:
        # the set tells most sentences apart, so only known ones are looked for in the list
        out = F.when(s.isin(*known), F.substring(letters, F.array_position(words, s).cast("int") + 1, F.lit(1)))
        for key, (begin, end, pattern) in FORMS.items():
            out = out.when(s.startswith(begin) & s.endswith(end) & s.rlike(pattern), F.lit(key))
        return out.otherwise(F.lit("."))

    return F.array_join(F.transform(sents, letter), "")


def rule_hits(ids: Column) -> Column:
    """Matched sequences from left to right."""
    several = [seq for _, seq in RULES if len(seq) > 1]
    single = "".join(seq for _, seq in RULES if len(seq) == 1)
    seen = {seq: i for i, (_, seq) in enumerate(RULES)}
    if any(seen[seq] > seen.get(seq[0], len(RULES)) for seq in several):
        raise ValueError("a rule of one letter stands before a longer one that begins with it")
    pattern = "|".join([*several, f"[{single}]"])
    return F.regexp_extract_all(ids, F.lit(f"({pattern})"), F.lit(1))


def own_notices(rules: Column, other: Column) -> Column:
    """``rules`` without "All rights reserved" where ``other`` reads it as the head of a BSD text."""
    return F.filter(rules, lambda x: (x != "g") | ~F.exists(other, lambda y: y.startswith("gX")))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: sentence counts, matched rules and licences.

    ``rules`` lists the matched sequences in text order of the reading by lines,
    then those of the reading by paragraphs that it does not have; ``licences``
    are the distinct names in order of name, both joined by blanks.
    """
    names = F.create_map(*[F.lit(x) for name, seq in RULES for x in (seq, name)])
    read = docs.select(
        "doc_id",
        F.size(sentences("text", ENDS_LINE)).cast("long").alias("n_sentences"),
        identifiers(sentences("text", ENDS_LINE)).alias("by_line"),
        identifiers(sentences("text", ENDS_TEXT)).alias("by_text"),
    )
    hits = read.select(
        "doc_id",
        "n_sentences",
        F.length(F.regexp_replace("by_line", r"\.", "")).cast("long").alias("n_known"),
        rule_hits(F.col("by_line")).alias("a"),
        rule_hits(F.col("by_text")).alias("b"),
    ).withColumn("a", own_notices(F.col("a"), F.col("b"))).withColumn(
        "rules", F.concat("a", F.filter("b", lambda x: ~F.array_contains(F.col("a"), x)))
    )
    return hits.select(
        "doc_id",
        "n_sentences",
        "n_known",
        F.array_join("rules", " ").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("rules", lambda r: names[r]))), " ").alias("licences"),
    )


def scan_sql() -> str:
    """The same scan for DuckDB."""
    known = known_sentences()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    letters = quote("." + "".join(known.values()))
    words = "[" + ", ".join(map(quote, known)) + "]"
    pattern = quote("|".join(seq for _, seq in RULES))
    names = "CASE r " + " ".join(f"WHEN {quote(seq)} THEN {quote(name)}" for name, seq in RULES) + " END"

    def sents(ends: str) -> str:
        cut = f"regexp_replace(lower(coalesce(text, '')), {quote(ends)}, chr(1), 'g')"
        flat = f"regexp_replace({cut}, '[^a-z0-9\\x01]+', ' ', 'g')"
        return f"[trim(s, ' ') FOR s IN string_split({flat}, chr(1)) IF trim(s, ' ') <> '']"

    forms = " ".join(f"WHEN regexp_matches(s, {quote(pattern)}) THEN {quote(key)}" for key, (_, _, pattern) in FORMS.items())

    def ids(s: str) -> str:
        known_id = f"substring({letters}, list_position({words}, s)::INT + 1, 1)"
        return f"array_to_string([CASE WHEN list_contains({words}, s) THEN {known_id} {forms} ELSE '.' END FOR s IN {s}], '')"

    return f"""
    WITH s AS (SELECT doc_id, {sents(ENDS_LINE)} AS l, {sents(ENDS_TEXT)} AS t FROM documents),
         i AS (SELECT doc_id, len(l) AS n_sentences, coalesce({ids('l')}, '') AS li, coalesce({ids('t')}, '') AS ti FROM s),
         h AS (SELECT *, regexp_extract_all(li, {pattern}) AS l0, regexp_extract_all(ti, {pattern}) AS b FROM i),
         o AS (SELECT *, [x FOR x IN l0 IF NOT (x = 'g' AND len([y FOR y IN b IF starts_with(y, 'gX')]) > 0)] AS a FROM h),
         r AS (SELECT *, list_concat(a, [x FOR x IN b IF NOT list_contains(a, x)]) AS rules FROM o)
    SELECT doc_id, n_sentences, length(replace(li, '.', '')) AS n_known,
           coalesce(array_to_string(rules, ' '), '') AS rules,
           coalesce(array_to_string(list_sort(list_distinct([{names} FOR r IN rules])), ' '), '') AS licences
    FROM r
    """
