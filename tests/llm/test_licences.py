import re

import duckdb
import pandas as pd

from folioscan.llm import licences as lc

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
CASES = [
    (1, MIT, "JKL", "MIT"),
    (2, "text here\nReleased under the MIT License.\nmore text.", "H", "MIT"),
    (3, "Words. Licensed under CC BY-NC 4.0. Licensed under the Apache License,\nVersion 2.0. End", "T A", "Apache-2.0 CC-BY-NC-4.0"),
    (4, "The MIT License is nice. We are not released under the MIT License today.", "", ""),
    (5, "mit.", "", ""),
    (6, None, "", ""),
    (7, "", "", ""),
    (None, "RELEASED  under the   MIT license!", "H", "MIT"),
    (8, "This work is licensed under the GNU General Public License, version 3.", "M", "GPL-3.0-only"),
    (8, "This work is licensed under the GNU General Public License, version 3.", "M", "GPL-3.0-only"),
    (9, "x " * 50_000 + "\nReleased under the MIT License.", "H", "MIT"),
]


def test_cases(spark, result):
    df = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    got = [(r["doc_id"], r["rules"], r["licences"]) for r in lc.scan(df).collect()]
    assert sorted(got, key=repr) == sorted(((c[0], c[2], c[3]) for c in CASES), key=repr)


def test_known_sentences_are_single_sentences():
    assert len(lc.known_sentences()) == len(lc.SENTENCES)
    assert not [s for s in lc.SENTENCES.values() if re.search(lc.ENDS_TEXT, s)]
    assert {c for _, seq in lc.RULES for c in seq} <= set(lc.SENTENCES)


def test_equals_sql_and_is_native(spark, docs, clashing, no_docs, rows, result):
    documents = pd.DataFrame([r[:2] for r in rows] + [c[:2] for c in CASES], columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(lc.scan_sql()).fetchall()
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string"))
    got = [tuple(r) for r in lc.scan(both).collect()]
    null = lambda rs: sorted(((None if r[0] != r[0] else r[0], *r[1:]) for r in rs), key=repr)
    fix = lambda rs: sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in null(rs)), key=repr)
    assert fix(got) == fix(want)
    assert result(lc.scan(clashing)) == result(lc.scan(docs))
    assert lc.scan(no_docs).count() == 0
    plan = lc.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
THIRD = """
3. Neither the name of Some Company nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""
ADVERT = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product has parts by Someone.
4. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission."""
LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the
License, or (at your option) any later version."""
AFFERO = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option)
any later version."""
MOZILLA = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""
SPDX_IDS = """GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only
LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 ISC BSD-2-Clause BSD-3-Clause CC0-1.0 CC-BY-4.0 MIT Apache-2.0""".split()
#: text, known sentences of the reading by lines, licences; all by hand
WHOLE = [
    ("Some words here\nAll rights reserved.", 1, "LicenseRef-proprietary"),
    ("Some words. Copyright (c) 2021 Some Company. All rights reserved.", 1, "LicenseRef-proprietary"),
    ("Copyright 2019-2024 Some Company, Inc. All Rights Reserved", 1, "LicenseRef-proprietary"),
    ("\u00a9 2020 Some Company, all rights reserved.", 1, "LicenseRef-proprietary"),
    ("Copyright (c) 2020 Some Company all rights reserved", 1, "LicenseRef-proprietary"),
    ("He said that all rights reserved are his.", 0, ""),
    (CLAUSES, 0, "BSD-2-Clause"),
    (CLAUSES + THIRD, 0, "BSD-3-Clause"),
    (CLAUSES + ADVERT, 0, "BSD-4-Clause"),
    ("Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + CLAUSES + THIRD, 1, "BSD-3-Clause"),
    (CLAUSES.replace("1.", "*").replace("2.", "*") + THIRD.replace("3.", "*"), 0, "BSD-3-Clause"),
    (LESSER, 1, "LGPL-2.1-or-later"),
    (AFFERO, 0, "AGPL-3.0-or-later"),
    (AFFERO.replace("Affero", "Lesser"), 0, "LGPL-3.0-or-later"),
    (MOZILLA, 0, "MPL-2.0"),
    (ISC, 0, "ISC"),
    ("Released under the LGPL v3.", 1, "LGPL-3.0"),
    ("Licensed under the GPL v3. All rights reserved.", 2, "GPL-3.0 LicenseRef-proprietary"),
    ("Licensed under CC0 1.0.", 1, "CC0-1.0"),
    *[(f"# SPDX-License-Identifier: {x}\nimport y", 1, x) for x in SPDX_IDS],
]


def test_families_notices_and_spdx_by_hand(spark):
    documents = pd.DataFrame([(i, w[0]) for i, w in enumerate(WHOLE)], columns=["doc_id", "text"])
    scanned = lc.scan(spark.createDataFrame(documents)).orderBy("doc_id").collect()
    assert [(r["n_known"], r["licences"]) for r in scanned] == [w[1:] for w in WHOLE]
    assert sorted(map(tuple, scanned)) == sorted(duckdb.sql(lc.scan_sql()).fetchall())
