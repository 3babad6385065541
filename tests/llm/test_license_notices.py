"""Licence notices: names, wrapped headers, several paragraphs, held-out notices, and the words that open a paragraph to scoring."""

from __future__ import annotations

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from wavequarry.llm import licenses

WRAPPED = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
}

# Notices that are no templates, as projects and pages word them; None: no licence at all.
NOTICES = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("Code released under the MIT license.", "MIT"),
    ("Distributed under the MIT License.", "MIT"),
    ("Available as open source under the terms of the MIT License.", "MIT"),
    ("Use of this code is governed by the Apache License, Version 2.0.", "Apache-2.0"),
    ("This project is licensed under the Apache License 2.0.", "Apache-2.0"),
    ("Released under the Apache License, Version 2.0, January 2004.", "Apache-2.0"),
    ("This program is distributed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under the GNU GPL version 3 or later.", "GPL-3.0"),
    ("The code is released under the GPLv3.", "GPL-3.0"),
    ("This file may be copied under the terms of GPLv2.", "GPL-2.0"),
    ("This library is licensed under the GNU Lesser General Public License version 2.1.", "LGPL"),
    ("Use of this source code is governed by a BSD-style license.", "BSD"),
    ("This software is released under the BSD 3-Clause License.", "BSD"),
    ("This file is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("Released under the ISC License, see LICENSE.", "ISC"),
    ("The text of this page is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Text is available under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Except where noted, content on this site is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Images are licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("This work is licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Copyright (c) 2020 Example Corp. All rights reserved.", "Proprietary"),
    ("Proprietary and confidential. All rights reserved.", "Proprietary"),
    ("See LICENSE.txt for the full text of the MIT license.", "MIT"),
    ("You may use this program under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed to the foundation under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This Source Code Form is subject to the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ("Our photographs are under Creative Commons Attribution-NonCommercial 4.0.", "CC-BY-NC-4.0"),
    ("Permission to use, copy and distribute this software for any purpose is granted, provided that the copyright notice appears in all copies.", "ISC"),
    ("Redistribution in source and binary forms is permitted provided that the following conditions are met.", "BSD"),
    ("No part of this book may be reproduced in any form without the prior written permission of the publisher.", "Proprietary"),
    ("A driving license is needed to rent a car.", "unknown"),
    ("Our license server will be down on Sunday.", "unknown"),
    ("The council gave its permission on Monday.", "unknown"),
    ("Distributed under a license of our own making.", "unknown"),
    ("Table reserved for the Smith family.", "unknown"),
    ("She studied at a school near the river.", None),
    ("The commons lie behind the old church.", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, (t, _) in enumerate(rows)], "doc_id long, text string, family string, row int")


def test_names_and_wrapped_notices(spark):
    wrapped = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [
        ("Distributed under the GPLv3.", "GPL-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"), ("This text is CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("dedicated to the public domain (CC0 1.0)", "unknown"), ("SPDX: MPL-2.0", "MPL-2.0"), ("A story.\n\n" + wrapped + "\n\nIt ends.", "GPL-3.0"), ("A plain story of a house.", None),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    assert {k: got[k].license for k in got} == {k: want for k, (_, want) in enumerate(rows)}
    assert (got[5].n_license, got[5].n_unknown, got[5].families) == (1, 0, ["GPL-3.0"])


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_headers_wrapped_in_comments_are_named(spark, prefix):
    rows = [("Some prose comes first.\n\n" + textwrap.indent("\n".join(textwrap.wrap(text, 70)), prefix) + "\n\nAnd prose follows.", family) for family, text in WRAPPED.items()]
    got = {r.doc_id: (r.license, r.n_license, r.n_unknown) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {k: (family, 1, 0) for k, (_, family) in enumerate(rows)}


def test_rows_in_are_rows_out_however_many_paragraphs_speak(spark):
    one = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "You need a license to fish here."]
    texts = {n: "A story.\n\n" + "\n\nmore\n\n".join(one[:n]) + "\n\nThe end." for n in (0, 1, 2, 5)}
    long = "\n\n".join(["word " * 200] * 100) + "\n\n" + one[0]
    rows = [(t, n) for n, t in texts.items()] * 3 + [(None, 0), ("", 0), (long, 1)]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    for r in got:
        n = rows[r.doc_id][1]
        families = sorted(["MIT", "CC-BY-NC-4.0", "Apache-2.0", "MPL-2.0"][: min(n, 4)])
        assert (r.n_license, r.n_unknown, r.families) == (min(n, 4), n // 5, families)
        assert (r.license in families) if n else r.license is None and r.score == 0


def test_held_out_notices_are_named(spark):
    templates = {t for _, t in licenses.templates()}
    notices = [(t, f) for t, f in NOTICES if t not in templates]
    assert len(notices) >= 35
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, notices)).collect()}
    named = {k for k, f in got.items() if f not in (None, "unknown")}
    true = {k for k, (_, f) in enumerate(notices) if f not in (None, "unknown")}
    right = {k for k in named & true if got[k] == notices[k][1]}
    missed = {notices[k]: got[k] for k in got if got[k] != notices[k][1]}
    print(len(right), len(named), len(true), missed)
    assert len(right) >= 0.9 * len(named) and len(right) >= 0.9 * len(true), missed
    assert all(got[k] is None for k, (_, f) in enumerate(notices) if f is None)


def test_no_template_nor_fifteen_words_of_one_are_kept_from_scoring(spark):
    texts = [t for _, t in licenses.templates()]
    parts = []
    for t in texts:
        words = re.findall(licenses.NOTICE_WORD, t.lower())
        parts += [t, *(" ".join(words[k : k + 15]) for k in range(len(words) - 14))]
    df = spark.createDataFrame([(p,) for p in parts], "text string")
    assert [r.text for r in df.where(~licenses.speaks(licenses.notice_words(F.col("text")))).collect()] == []
