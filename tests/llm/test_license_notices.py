"""Notices under five words against plain text search."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import license_scan
from tallyspark.llm.license_scan import Match, Scanner, Template
from tallyspark.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_short(text, notices):
    words, found = license_scan.text_words(text), []
    for notice in notices:
        own, end = license_scan.text_words(notice.text), -1
        for at in range(len(words) - len(own) + 1):
            if words[at:at + len(own)] == own and at > end:
                end = at + len(own) - 1
                found.append(Match(notice.name, 1.0, at, end))
    return sorted(found, key=lambda m: (m.first_word, m.license))


def test_places_of_notices():
    notices = [*license_scan.NOTICES, Template("one", "Copyleft"), Template("aba", "a b a"), Template("four", "a b c d")]
    scanner = Scanner(notices=notices)
    texts = [None, "", "all", "All rights", "All rights reserved", "(c) ACME. ALL RIGHTS\nRESERVED! all rights reserved",
             "copyleft", "a b a c d", "a b a b a b c d all rights", "x all right reserved", "é all rights reserved é"]
    for text in texts:
        assert scanner.scan_all(text) == (scanner.scan(text), plain_short(text, notices))
    assert len(scanner.scan_all(texts[5])[1]) == 2
    for text in ("", "five words are a template"):
        with pytest.raises(ValueError):
            Scanner(notices=[Template("n", text)])


def test_operator_finds_both(spark):
    text = "Released under the MIT License. All rights reserved."
    df = spark.createDataFrame([(1, text), (2, None)], "`doc.id` long, text string")
    got = {r[0]: r for r in license_scan.scan(df, id_col="doc.id").collect()}
    assert [m.license for m in got[1].matches] == ["MIT-line"]
    assert [tuple(m) for m in got[1].short_matches] == [("All-rights-reserved", 1.0, 5, 7)]
    assert got[2].matches == got[2].short_matches == []
    only = license_scan.scan(df, templates=[], id_col="doc.id").collect()
    assert sorted(len(r.short_matches) for r in only) == [0, 1]


def test_query_names_every_reserved_right(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["op2_license_scan"](spark, SF_DIR)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    named = 0
    for row in found.collect():
        short = plain_short(texts[row.doc_id], license_scan.NOTICES)
        assert [Match(*m) for m in row.short_matches] == short
        assert row.n_matches == len(row.matches) + len(short)
        assert row.licenses == sorted({m.license for m in row.matches} | {m.license for m in short})
        named += "All-rights-reserved" in row.licenses
    assert named > 0
    assert found.filter(F.col("n_matches") == 0).count() < len(texts)


TEXTS = {
    "BSD-3-Clause": "Copyright (c) 2019, ACME\n\n* Redistribution and use in source and binary forms, with or without\n* "
                    "modification, are permitted provided that the following conditions are met:\n"
                    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this "
                    "list of conditions and the following disclaimer in the documentation and/or other materials provided with "
                    "the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be "
                    "used to endorse or promote products derived from this software without specific prior written "
                    "permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
                    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL",
    "AGPL-3.0-line": "// SPDX-License-Identifier: AGPL-3.0-or-later",
    "LGPL-2.1-line": "# SPDX-License-Identifier: LGPL-2.1-only",
    "CC-BY-4.0-line": "Text: licensed under CC BY 4.0!",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "/* SPDX-License-Identifier: MIT */",
}


def test_each_text_is_named_by_its_own_license(spark, tmp_path):
    """Also texts that a sister license shares most of, and those that a few words were changed in."""
    own = [(t.name, t.text) for t in license_scan.TEMPLATES + license_scan.NOTICES]
    rows = [*TEXTS.items(), *own, *((name, text.replace("this list of", "these")) for name, text in own)]
    rows = [(i, name, f"Some words before. {text} And some after.") for i, (name, text) in enumerate(rows)]
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).collect()}
    for i, name, text in rows:
        assert [n for n in got[i].licenses if n in (name, name.removesuffix("-line")) or not n.endswith("-line")
                or name.endswith("-line")] == [name], text
    assert {"AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "LGPL-2.1", "LGPL-3.0"} <= {name for _, name, _ in rows}
