import pytest

from triptych.llm import licences
from triptych.llm.text import table

SCHEMA = "doc_id bigint, text string, family string, p string, paragraph int"
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
# Texts, and the notices that are in them.
CASES = [
    (MIT, "0:MIT"),
    ("Some words.\n\n" + MIT.replace(", to deal", ",\nto deal").replace("copy, modify", "copy,\nmodify") + "\n\nMore words.", "2:MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met:", "0:unknown"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0:unknown"),
    (GPL.format(3), "0:GPL-3.0"),
    (GPL.format(2), "0:GPL-2.0"),
    (GPL.format(3).replace("GNU General", "GNU Affero General"), "0:unknown"),
    (GPL.format(3).replace("GNU General", "GNU Lesser General"), "0:LGPL-3.0"),
    (GPL.format(2.1).replace("GNU General", "GNU Lesser General"), "0:unknown"),
    ("# SPDX-License-Identifier: MIT", "0:MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "0:GPL-2.0"),
    ("SPDX-License-Identifier: MIT-0", "0:unknown"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "0:unknown"),
    ("Our code is licensed under the Apache\nLicense, Version 2.0 and nothing else.", "0:Apache-2.0"),
    ("Licensed under the Quux Internal License, version 9.\nReleased under the MIT License.", "0:unknown,1:MIT"),
    ("Nothing of that kind is here.\nShe asked for the software and went home.", ""),
]


@pytest.fixture(scope="module")
def found(spark, folder):
    classifier = licences.train(table(spark, folder, "documents"))
    df = spark.createDataFrame([(i, text, None, None, 0) for i, (text, _) in enumerate(CASES)], SCHEMA)
    return {r.doc_id: r.notices for r in licences.scan(df, classifier).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_texts_headers_and_identifiers(found, case):
    assert found[case] == CASES[case][1]
