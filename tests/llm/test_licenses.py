import textwrap
from pathlib import Path

import pytest

from sparkredact.llm import licenses
from sparkredact.llm.license_texts import BSD_3, BSL, DIGESTS, MIT, TEXTS, ZLIB


def test_equivalent_copies_match_and_others_do_not(spark):
    wrapped = "\n".join("  * " * 0 + line for line in textwrap.wrap(MIT, 60))
    rows = [
        (1, MIT),
        (2, "The MIT Licence (MIT)\n\nCopyright (c) 2019-2021 Some One\n\n" + wrapped.upper()),
        (3, MIT.replace('"', "“").replace("sublicense", "sub-licence") + "\n\n\n"),
        (4, BSD_3.replace("1.", "*").replace("2.", "(b)").replace("3.", " -") + "\nAll rights reserved."),
        (5, MIT + " And more."),
        (6, None),
        (6, ""),
        (7, "Prose.\n  released under THE MIT licence\nmore prose\nLicensed under CC BY-NC 4.0."),
        (8, ZLIB.replace("acknowledgment", "acknowledgement")),
        (None, "Released under the MIT License."),
        (9, "licence " * 50_000),
        (10, "We say: Released under the MIT License."),
        (11, "Boost Software Licence - Version 1.0 - August 17th, 2003\n\nCopyright 2004 Some One\n\n" + "\n".join(textwrap.wrap(BSL, 70)).replace("NON-INFRINGEMENT", "NONINFRINGEMENT")),
        (12, BSL),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string").repartition(3)
    got = {(r.doc_id, r.license_id, ",".join(r.notices)) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT", ""), (2, "MIT", ""), (3, "MIT", ""), (4, "BSD-3-Clause", ""), (5, None, ""), (6, None, ""), (7, None, "CC-BY-NC-4.0,MIT"), (8, "Zlib", ""), (None, "MIT", "MIT"), (9, None, ""), (10, None, ""), (11, "BSL-1.0", ""), (12, "BSL-1.0", "")}
    assert licenses.scan(df).count() == len(rows)


def test_long_licences_are_known(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all((folder / f).exists() for f in files):
        pytest.skip("no licence texts on this machine")
    rows = [(i, (folder / f).read_text()) for i, f in enumerate(files)]
    cut = (folder / "GPL-3").read_text().split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"
    rows += [(10, cut), (11, " ".join(rows[3][1].split("\n")[4:])), (12, rows[3][1] + "more")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(files.values())), 10: "GPL-3.0", 11: None, 12: None}


def test_digests_differ(spark):
    digests = [d for _, d in DIGESTS] + [r.text_digest for r in licenses.known(spark).collect()]
    assert len(set(digests)) == len(digests)


def test_notices_without_the_word_license(spark):
    df = spark.createDataFrame([(1, "Prose.\n Public  domain!\nReleased under the MIT Licence."), (2, "In the public domain.")], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in licenses.scan(df, notices=[("PD", "Public domain."), ("MIT", "Released under the MIT License.")]).collect()}
    assert got == {1: ["MIT", "PD"], 2: []}


def test_known_texts_differ(spark):
    assert licenses.known(spark).count() == len({t for _, t in TEXTS}) + len(licenses.NOTICES)


def test_native_plan_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = licenses.scan(empty)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.count() == 0
