"""License rules on texts, notices, addresses and look-alikes; no gate hides what a rule matches; time on long texts."""

import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provider_analytics.llm import licenses

RULES = licenses.signature_rules()
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
       "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
       "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
       "2. Redistributions in binary form must reproduce the above copyright notice in the documentation. ")
NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."
ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product. "
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
FSF = "under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."

CASES = [
    (MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    (MIT + ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY", "mit-0"),
    (MIT.replace("deal in", "deal with").replace("(the \"Software\")", "(the \"Software\")"), "ncsa"),
    (BSD, "bsd-2-clause"), (BSD + NAMES, "bsd-3-clause"), (BSD + ADS + NAMES, "bsd-4-clause"),
    (ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    (ISC + ". THE SOFTWARE IS PROVIDED \"AS IS\"", "0bsd"),
    (FSF.format("General", "3"), "gpl-3"), (FSF.format("General", "2"), "gpl-2"), (FSF.format("Lesser General", "2.1"), "lgpl-2.1"),
    (FSF.format("Lesser General", "3"), "lgpl-3"), (FSF.format("Affero General", "3"), "agpl-3"), (FSF.format("Library General", "2"), "lgpl-2"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "gpl-3"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lgpl-2.1"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache-2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "epl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib"),
    ("https://creativecommons.org/licenses/by-sa/4.0", "cc-by-sa"), ("see creativecommons.org/licenses/by-nc-nd/3.0/it/", "cc-by-nc-nd"),
    ("http://creativecommons.org/licenses/by/4.0/", "cc-by"), ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1"),
    ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"), ("https://opensource.org/licenses/MIT", "mit"), ("https://spdx.org/licenses/EPL-2.0.html", "epl-2"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"), ("opendatacommons.org/licenses/odbl/1-0/", "odbl-1"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR MPL-2.0", "bsd-3-clause,gpl-2,mpl-2"),
    ("This work has been released into the public domain.", "public-domain"), ("licensed under the EUPL, Version 1.2", "eupl-1.2"),
    ("you can do so as long as you retain this notice you can do whatever you want with this stuff", "beerware"),
    ("The Software shall be used for Good, not Evil.", "json"), ("governed by the CeCILL-B license under French law", "cecill"),
    ("released under the MIT license", "mit"), ("It is distributed under the BSD license.", "bsd"), ("the ISC license", "isc"),
]
NOTHING = [
    "data provided by MIT and Stanford", "courses available by mit", "php license of the city", "ruby license plate", "his driver's license was revoked",
    "a fishing license in Elastic Creek", "the code is not licensed under the GPL license", "it was never in the public domain", "an artistic license",
    "license number 2 0 of the shop", "permission is hereby granted to park", "redistribution and use of land", "the president of the united states",
    "creative commons of the village", "zlib and libpng are installed", "general elections in public", "apache helicopters fly", "postgresql license plates",
]


@pytest.mark.parametrize("text, labels", [*CASES, *[(text, "") for text in NOTHING]])
@pytest.mark.parametrize("frame", ["{}", "Some words before. {}\n\nAnd some words après."])
def test_texts(text, labels, frame):
    got = licenses.scan_text(frame.format(text).encode(), RULES)
    assert ",".join(got["labels"]) == labels
    assert (got["score"] > 0) == bool(labels)


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_no_gate_hides_a_match(data):
    rule = data.draw(st.sampled_from(RULES))
    core = rule.pattern.pattern.decode().removeprefix(r"(?<!\S)").removesuffix(r"(?!\S)")
    text = data.draw(st.from_regex(core, fullmatch=True, alphabet=string.ascii_lowercase + string.digits + " ")).encode()
    assert any(keyword in text for keyword in rule.keywords), (rule, text)
    if rule.label:
        assert any(anchor in text for anchor in licenses._ANCHORS), (rule, text)


@pytest.mark.parametrize("piece", [
    "under the mit license ", "Redistribution and use in source and binary forms, with or without modification, are permitted ",
    "SPDX-License-Identifier: MIT OR ", "not released under the ", "license ",
])
def test_time_grows_with_the_text_only(piece):
    spent = []
    for size in (200_000, 800_000):
        started = time.process_time()
        licenses.scan_text((piece * (size // len(piece))).encode(), RULES)
        spent.append(time.process_time() - started)
    assert spent[1] < 10 * spent[0] + 1
