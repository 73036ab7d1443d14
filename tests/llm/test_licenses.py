import re

import pytest
from pyspark.sql import functions as F

from kassa.llm import licenses as lc

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2019 X
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
"""
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
CASES = [
    (None, []), ("", []), ("no word of it", []), (MIT, ["MIT"]), ("x y z.\n" + MIT.upper(), ["MIT"]),
    ("/* " + MIT.replace("\n", "\n * "), ["MIT"]), ("\n".join(BSD), ["BSD-2-Clause"]),
    ("\n".join(BSD + [lc.SENTENCES["bsd-endorse"][0] + "."]), ["BSD-3-Clause"]), (BSD[1], []),
    ("Text before\nLicensed under CC BY-NC 4.0.\nText after", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("RELEASED%%% UNDER*** THE### MIT&&& LICENSE.$$$ more", ["MIT"]), ("Released | under | the | MIT | License.", ["MIT"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("Licensed under the Apache License, Version 2.0. a b c. Released under the MIT License. Released under MIT", ["Apache-2.0", "MIT"]),
    ("Our license is not released under the MIT License yet", []), ("licence " * 50000, []),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lc.scan(docs.withColumn("licenses", F.lit(1))).collect()}
    for i, (text, want) in enumerate(CASES):
        assert rows[i].licenses == want, (text and text[:90], rows[i])
    assert rows[8].unmatched == ["bsd-source"] and rows[8].n_known == 1 and rows[3].unmatched == []
    assert lc.scan(docs.limit(0)).count() == 0


def test_apache_header_is_one_licence():
    s = lc.Scanner()
    ids = s.identifiers(APACHE.replace(' (the "License")', ""))
    assert ids == ["copyright", "ref:Apache-2.0", "apache-use", "apache-copy"]
    assert s.licences(ids) == (["Apache-2.0"], [])


def test_rule_order_and_own_rules(spark):
    table = {"a": ("alpha beta",), "b": ("gamma delta",)}
    rules = (("Both", ("a", "b")), ("A", ("a",)))
    s = lc.Scanner(table, rules)
    assert s.licences(s.identifiers("Alpha beta. Gamma\ndelta. Alpha (beta)")) == (["Both", "A"], [])
    docs = spark.createDataFrame([(1, "alpha beta; gamma delta.")], "doc_id long, text string")
    assert lc.scan(docs, sentences=table, rules=rules, hint="alpha").first().licenses == ["Both"]


def test_every_known_sentence_holds_a_hint():
    s = lc.Scanner()
    hint = re.compile(lc.HINT)
    table = dict(lc.SENTENCES)
    table.update(lc._references()[0])
    missing = [f for forms in table.values() for f in forms if not hint.search(f.lower())]
    assert missing == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    """Brute force: the reference lines of the shared tables by plain search."""
    plain = {"licensed under cc by-nc 4.0": "CC-BY-NC-4.0", "licensed under the apache license version 2.0": "Apache-2.0",
             "this work is licensed under the gnu general public license version 3": "GPL-3.0-only",
             "released under the mit license": "MIT"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: set(r.licenses) for r in lc.op4_license_scan(spark, sf).collect()}
    for d in docs:
        flat = " ".join(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", d.text.lower()))
        assert got[d.doc_id] == {v for k, v in plain.items() if k in flat}, d.doc_id
    assert sum(map(bool, got.values())) > 10
