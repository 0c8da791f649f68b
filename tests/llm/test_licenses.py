"""Licence notices as they are written: named holders, GNU notices, titles, SPDX expressions, odd tables."""

from tokentally.llm import op8_licenses
from tokentally.llm.queries import QUERIES

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
   the documentation and/or other materials provided with the distribution.
"""
GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}
as published by the Free Software Foundation; {2}.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
LATER = "either version {} of the License, or (at your option) any later version"
CASES = {
    BSD + "3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived\n"
          "   from this software without specific prior written permission.": ["BSD-3-Clause"],
    BSD + "* Neither the names of the copyright holders nor the names of their contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.": ["BSD-3-Clause"],
    BSD: ["BSD-2-Clause"],
    GNU.format("library", "Lesser General Public License", LATER.format("2.1")): ["LGPL-2.1-or-later"],
    GNU.format("program", "General Public License", LATER.format("2")): ["GPL-2.0-or-later"],
    GNU.format("program", "General Public License", "version 2 of the License"): ["GPL-2.0-only"],
    GNU.format("program", "Affero General Public License", LATER.format("3")): ["AGPL-3.0-or-later"],
    "Licensed under the GNU GPL v2.": ["GPL-2.0-only"],
    "This program is licensed under the GPLv3.": ["GPL-3.0-only"],
    "Distributed under the LGPL version 2.1 or later.": ["LGPL-2.1-or-later"],
    "This file is licensed under the MIT License.": ["MIT"],
    "MIT License": ["MIT"],
    "Distributed under CC BY 4.0": ["CC-BY-4.0"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": ["EPL-2.0"],
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is "
    "available at http://x.org": ["EPL-2.0"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
    "# SPDX-License-Identifier: BSL-1.0\n": ["BSL-1.0"],
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) AND ISC */": ["BSD-3-Clause", "GPL-2.0-only", "ISC"],
    "<!-- SPDX-License-Identifier: MPL-2.0 -->": ["MPL-2.0"],
    "SPDX-License-Identifier: MIT and more words": ["MIT"],
    "SPDX-License-Identifier: MIT, as said": ["MIT"],
    "the licence of the mit is no mit license, it is said": [],
}


def test_notices(spark):
    docs = list(enumerate(CASES))
    got = {r["doc_id"]: r["licences"] for r in op8_licenses.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wrong = {text[-90:]: (got.get(i, []), want) for i, (text, want) in enumerate(CASES.items()) if got.get(i, []) != want}
    assert not wrong


def test_odd_tables(spark, write_tables):
    long = "plain words " * 50_000 + ". Released under the MIT License. " + "more words " * 1000
    rows = [(1, long, "x"), (1, long, "x"), (None, "Released under the MIT License.", None), (2, None, "y"), (3, "", "z"),
            (4, "Released under the MIT License. Released under the MIT License.", "w")]
    d = write_tables(documents=(rows, "doc_id long, text string, sentence string"))
    got = sorted(((r["doc_id"], r["n_sentences"], r["licences"]) for r in QUERIES["op8_licenses"](spark, d).collect()), key=repr)
    assert got == sorted([(1, 1, ["MIT"]), (1, 1, ["MIT"]), (None, 1, ["MIT"]), (2, 0, []), (3, 0, []), (4, 2, ["MIT"])], key=repr)


def test_known_sentences_have_an_anchor():
    import re
    anchors = re.compile(op8_licenses.ANCHORS.replace("(?i)", ""), re.I)
    lost = [s for s, _ in op8_licenses.sentences() if not anchors.search(s)]
    assert not lost
