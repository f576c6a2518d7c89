import pytest

from examlake.llm.license_scan import MARKERS, RULES, SENTENCES, license_scan

SCHEMA = "doc_id long, text string, licenses string"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_tables_are_consistent():
    known = [s for v in SENTENCES.values() for s in v]
    assert len(known) == len(set(known))
    assert all(any(m in s for m in MARKERS) for s in known)
    assert all(p in SENTENCES for _, parts in RULES for p in parts)


def test_scan(spark):
    texts = [
        None,
        "",
        "Nothing to see here.",
        "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.",
        "prose without a stop\nReleased under the MIT License",
        MIT,
        "Copyright (c) me. All rights reserved. Released under the MIT License. Licensed under the Apache License, Version 2.0!",
        "We have all rights reserved for you.",
        "You may not use this file except in compliance with the License.",
        "// SPDX-License-Identifier: MIT\n",
        "x " * 50_000 + ".\nThis work is licensed under the GNU General Public License, version 3.\n",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], ""), (3, texts[3], "")]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    want = {0: "", 1: "", 2: "", 3: "CC-BY-NC-4.0", 4: "MIT", 5: "MIT", 6: "All-Rights-Reserved;Apache-2.0;MIT", 7: "", 8: "", 9: "MIT", 10: "GPL-3.0", None: "CC-BY-NC-4.0"}
    assert {k: r.licenses for k, r in by.items()} == want
    assert by[5].sentence_ids == "<mit-grant><mit-notice>" and by[5].unruled == 0
    assert by[8].sentence_ids == "<apache-comply>" and by[8].unruled == 1
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_tables_and_order(spark):
    ids = {"a": ("one licens",), "b": ("two licens",)}
    rules = (("AB", ("a", "b")), ("A", ("a",)))
    rows = [(1, "one licens. Other words; two licens", ""), (2, "two licens. one licens", "")]
    got = {r.doc_id: (r.licenses, r.unruled) for r in license_scan(spark.createDataFrame(rows, SCHEMA), ids, rules, ("licens",)).collect()}
    assert got == {1: ("AB", 0), 2: ("A", 1)}


def test_the_gate_lets_every_spacing_through(spark):
    rows = [(i, f"Copyright me. All{a}Rights{b}Reserved.", "") for i, (a, b) in enumerate([("\n", "\n"), (" ", "\n"), ("  ", "  "), ("\t", "\t"), ("\u00a0", "\u00a0"), (", ", " / ")])]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.sentence_ids, r.licenses) for r in got] == [("<reserved>", "All-Rights-Reserved")] * len(rows)
    own = license_scan(spark.createDataFrame([(1, "Feel free!", ""), (2, "other", "")], SCHEMA), {"a": ("feel free",)}, (("A", ("a",)),)).collect()
    assert [r.licenses for r in own] == ["A", ""]


def test_every_sentence_is_found_as_text(spark):
    known = [(s, k) for k, v in SENTENCES.items() for s in v]
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    rows = [(i, f"Some words. {s.capitalize()}. More words.", "") for i, (s, _) in enumerate(known)] + [(-1, mpl, "")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[-1].licenses == "MPL-2.0"
    assert [got[i].sentence_ids for i in range(len(known))] == [f"<{k}>" for _, k in known]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", "- ", "; ", "%% "])
def test_headers_in_comments(spark, mark):
    no_gaps = lambda t: "\n".join(x for x in t.split("\n") if x.strip())
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[: BSD.index("3. ")], "GPL-2.0-or-later": GPL, "GPL-3.0-or-later": GPL.replace("version 2", "version 3")}
    rows, want = [], []
    for k, t in texts.items():
        for t in (t, no_gaps(t) if k == "Apache-2.0" else t):
            body = "\n".join((mark + x).rstrip() for x in t.split("\n"))
            rows.append((len(rows), f"{mark}Copyright 2020 Some One\n{mark.rstrip()}\n{body}\n\ncode = 1\n", "x"))
            want.append(k)
    rows += [(100, f"{mark}SPDX-License-Identifier: MIT", ""), (101, f"{mark}Licensed under the MIT License", ""), (102, f"<!-- {mark}SPDX-License-Identifier: MIT -->\r\n", "")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[i].licenses, got[i].unruled) for i in range(len(want))] == [(k, 0) for k in want]
    assert [got[i].licenses for i in (100, 101, 102)] == ["MIT"] * 3
    assert got[0].sentence_ids.count("<") == 5
