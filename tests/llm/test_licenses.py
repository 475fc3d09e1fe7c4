"""License scans on known wordings."""

import pytest

from tests.llm.cases import ODD, documents
from tidemark.llm import licenses

MIT = (
    "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
    "of this software, to deal in it without restriction. The above copyright notice and this permission notice shall be\n"
    'included in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE\n'
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."
)
BSD = (
    "Redistribution and use in source and binary forms are permitted:\n\n1. Redistributions of source code must retain the notice.\n"
    "2. Redistributions in binary form must reproduce the notice.\n"
)
CASES = [
    ("Released under the MIT License.", "MIT", "known"),
    ("word without end\nReleased under the MIT License.\nmore words", "MIT", "known"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", "known"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "known"),
    ("either version 3 of the GNU General Public License, or (at your option) any later version.", "GPL-3.0-or-later", "known"),
    ("GNU General Public License version 2 or (at your option) any later version.", "GPL-2.0-or-later", "known"),
    ("GNU Lesser General Public License v2.1 only.", "LGPL-2", "known"),
    ("GNU Affero General Public License version 3.", "AGPL-3.0", "known"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC", "known"),
    ("Licensed under CC BY 4.0.", "CC-BY", "known"),
    ("All rights reserved.", "All-rights-reserved", "known"),
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Apache-2.0,MIT", "known"),
    ("You may use it as licensed under our own terms.", "Unknown", "unknown"),
    ("SPDX-License-Identifier: MIT", "MIT", "known"),
    (BSD, "BSD-2-Clause", "known"),
    (BSD + "3. Neither the name of X nor its contributors may be used to endorse or promote products.", "BSD-3-Clause", "known"),
    ("A text that says nothing of the kind, mit Freunden.", "", "none"),
    ("permission", "", "none"),
]


@pytest.mark.parametrize("repeat", [1, 2])
def test_known_wordings(spark, repeat):
    texts = [((t + "\n\nplain words here. ") * repeat) for t, _, _ in CASES]
    got = {r["doc_id"]: (r["licences"], r["status"]) for r in licenses.scan(documents(spark, texts)).collect()}
    for i, (text, licence, status) in enumerate(CASES):
        assert got[i] == (licence, status), text


def test_whole_mit_text(spark):
    (row,) = licenses.scan(documents(spark, [MIT])).collect()
    assert row["licences"].split(",")[0] == "MIT" and "MITgrant,MITnotice,AsIs,NoLiability" in row["sentence_ids"]


def test_odd_texts_repeats_and_nothing(spark):
    rows = licenses.scan(documents(spark, ODD + ["MIT License"] * 2, ids=[None] * len(ODD) + [1, 1])).collect()
    assert sorted(r["status"] for r in rows) == ["known"] * 2 + ["none"] * len(ODD)
    assert licenses.scan(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


HOLDERS = [
    "Google Inc.", "the University of California, Berkeley", "Foo Inc.", "FOO CO. LTD.", 'Apple Computer, Inc. ("Apple")', "John Q. Public",
    "St. Jude Hospital",
]


@pytest.mark.parametrize("wrap", [" ", "\n", "\n * "])
def test_points_in_names_end_no_sentence(spark, wrap):
    clause = "* Neither the name of {} nor the names of its contributors may be used to endorse or promote products without permission.\n"
    asis = "THIS SOFTWARE IS PROVIDED BY {} AND CONTRIBUTORS AS IS. IN NO EVENT SHALL THE AUTHORS OF {} OR CONTRIBUTORS BE LIABLE."
    short = "Copyright (c) 2010 Foo Inc. Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright "
    short += "notice and this permission notice shall be included."
    texts = [BSD + (clause + asis.replace("{}", "FOO INC.")).replace(" ", wrap).format(h) for h in HOLDERS]
    texts += ["Licensed under the Apache License, v. 2.0.".replace(" ", wrap), short]
    texts += ["1. Redistributions of source code must retain the notice of Foo Inc.\n2. Redistributions in binary form must reproduce it."]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i in range(len(HOLDERS)):
        assert got[i]["licences"] == "BSD-3-Clause", texts[i]
        assert got[i]["sentence_ids"] == "BSDhead,BSDsource,BSDbinary,BSDendorse,AsIs,NoLiability", texts[i]
    ends = [got[len(HOLDERS) + k]["licences"] for k in range(3)]
    assert ends == ["Apache-2.0", "MIT", "BSD-2-Clause"]


SAMPLES = {
    "MITgrant": "permission is hereby granted free of charge to any person obtaining a copy",
    "MITref": "the mit x11 license|mit style licence|licensed under mit|spdx-license-identifier mit",
    "MITnotice": "the above copyright notice and this permission notice shall be included",
    "ISCgrant": "permission to use copy modify and or distribute this software for any purpose",
    "ISCref": "an isc license|spdx-license-identifier isc",
    "AsIs": "the software is provided as is|software is provided by me as is",
    "NoLiability": "in no event shall the authors be liable|in no event shall the contributors of it be liable",
    "BSDsource": "redistributions of source code must retain it",
    "BSDbinary": "redistributions in binary form must reproduce it",
    "BSDhead": "redistribution and use in source and binary forms",
    "BSDendorse": "neither the name of x nor others may be used to endorse or promote",
    "BSD3ref": "bsd-3|a 3-clause bsd text|the revised bsd licence",
    "BSD2ref": "bsd 2|a 2 clause bsd text|simplified bsd license",
    "BSDref": "a bsd style license",
    "Apache2ref": "apache software license version 2|apache-2.0",
    "Apache1ref": "apache licence v1",
    "ApacheRef": "the apache license",
    "Apache2terms": "you may not use this file except in compliance with the license",
    "Apache2copy": "you may obtain a copy of the license at",
    "Apache2basis": "distributed on an as is basis",
    "AGPL3later": "affero general public license v3 or any later version|agpl-3.0-or-later",
    "AGPL3ref": "affero general public license 3|agplv3",
    "LGPL3later": "lesser general public license 3 or later|lgpl-3.0-or-later",
    "LGPL3ref": "library general public license 3|lgpl-3",
    "LGPL2later": "lesser general public license 2 or newer|lgpl-2.1-or-later",
    "LGPL2ref": "lesser general public license v2|lgpl v2",
    "GPL3later": "general public license 3 and later|version 3 of the gnu general public license or any later one|gpl-3.0-or-later",
    "GPL3ref": "general public license v3|version 3 of the gnu general public license|gpl v3",
    "GPL2later": "general public license 2 or later|version 2 of the gnu general public license or later|gpl-2.0-or-later",
    "GPL2ref": "general public license v2|version 2 of the gnu general public license|gpl2",
    "GPLref": "general public licence",
    "GPLnowarranty": "distributed in the hope that it will be useful but without any warranty",
    "MPL2ref": "mozilla public license 2|mpl-2.0",
    "MPL1ref": "mozilla public license",
    "EPLref": "eclipse public license",
    "BSLref": "boost software license",
    "ZlibRef": "zlib libpng license",
    "Unlicense": "free and unencumbered software released into the public domain|the unlicense",
    "PublicDomain": "public domain",
    "CC0ref": "cc0|cc zero|creative commons zero",
    **{
        f"CCBY{name}ref": "|".join(f"{who} {by}{rest}" for who in ("cc", "creative commons") for by in ("by", "attribution"))
        for name, rest in (
            ("NCSA", "-nc-sa"), ("NCND", "-noncommercial-noderivs"), ("NC", " nc"), ("SA", "-sharealike"), ("ND", " nd"), ("", " 4.0"),
        )
    },
    "Copyright": "copyright 2020 x",
    "AllRights": "all rights reserved",
    "Unknown": "licensed under our own|the terms of this licence",
}


@pytest.mark.parametrize("wrap", [" ", "\n", "\n# ", " (\r\n\t"])
def test_every_pattern_passes_the_gate(spark, wrap):
    assert {n for family in licenses.FAMILIES for n, _ in family} | {"Unknown"} == set(SAMPLES)
    cases = [(name, text.replace(" ", wrap)) for name, texts in SAMPLES.items() for text in texts.split("|")]
    rows = licenses.scan(documents(spark, [t.upper() for _, t in cases])).collect()
    got = {r["doc_id"]: r["sentence_ids"].split(",") for r in rows}
    assert [c for i, c in enumerate(cases) if c[0] not in got[i]] == []


def test_attribution_after_cc(spark):
    (row,) = licenses.scan(documents(spark, ["Photo released under CC Attribution-ShareAlike 3.0 by its author."])).collect()
    assert (row["licences"], row["status"]) == ("CC-BY-SA", "known")
