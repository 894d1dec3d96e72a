"""License detection by ordered signature rules.

A document is reduced to its words once. Keywords decide whether any rule can match at all; the rules whose keyword
occurs run their regex over the words: sentences of the license texts, notices, addresses, and names in their uses. Every
detection has an interval and a priority, and one that lies inside an interval already kept is suppressed, so `GNU Lesser
General Public License` is not also a GPL. Look-alikes, as in `license plate`, only suppress."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The phrases and labels every result must hold.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Words that a name consists of, as a regex over words separated by one space, the keyword that must occur in the
# text, and whether the bare name says enough without the word license beside it.
_NAMES = (
    ("mit", r"(?:mit|expat)", "mit|expat", False),
    ("mit-0", r"mit (?:0|no attribution)", "mit", True),
    ("apache-1.0", r"apache(?: software)?(?: license)?(?: version| v)? 1 0", "apache", True),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache", True),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache", True),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd", True),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd", True),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd", True),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "bsd", True),
    ("bsd", r"(?:berkeley software distribution|bsd)", "bsd|berkeley", False),
    ("gpl-1", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?", "gpl|general public", True),
    ("gpl-2", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", "gpl|general public", True),
    ("gpl-3", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", "gpl|general public", True),
    ("gpl", r"(?:gnu general public license|gnu gpl|gpl)", "gpl|general public", True),
    ("lgpl-2", r"(?:gnu )?(?:library general public license|lgpl)(?: version| v)? ?2(?: 0)?", "lgpl|library general", True),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1", "lgpl|lesser general", True),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl|lesser general", True),
    ("lgpl", r"(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl)", "lgpl|lesser general|library general", True),
    ("agpl-3", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", "agpl|affero", True),
    ("agpl", r"(?:gnu affero general public license|gnu agpl|agpl)", "agpl|affero", True),
    ("gfdl-1.1", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?1 1", "gfdl|free documentation", True),
    ("gfdl-1.2", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?1 2", "gfdl|free documentation", True),
    ("gfdl-1.3", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?1 3", "gfdl|free documentation", True),
    ("gfdl", r"(?:gnu free documentation license|gfdl)", "gfdl|free documentation", True),
    ("mpl-1.0", r"(?:mozilla public license|mpl)(?: version| v)? 1 0", "mpl|mozilla", True),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? 1 1", "mpl|mozilla", True),
    ("mpl-2", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", "mpl|mozilla", True),
    ("mpl", r"mozilla public license", "mozilla", True),
    ("epl-1", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", "epl|eclipse", True),
    ("epl-2", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", "epl|eclipse", True),
    ("epl", r"eclipse public license", "eclipse", True),
    ("cddl-1", r"(?:common development and distribution license|cddl)(?: version| v)? ?1(?: 0)?", "cddl|common development", True),
    ("cddl", r"(?:common development and distribution license|cddl)", "cddl|common development", True),
    ("cpl-1", r"(?:common public license|cpl)(?: version| v)? ?1(?: 0)?", "cpl|common public", True),
    ("eupl-1.1", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 1", "eupl|european union", True),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2", "eupl|european union", True),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", "eupl|european union", True),
    ("artistic-1", r"artistic license(?: version| v)? ?1(?: 0)?", "artistic", True),
    ("artistic-2", r"artistic license(?: version| v)? ?2(?: 0)?", "artistic", True),
    ("artistic", r"(?:perl artistic|artistic)", "artistic", False),
    ("isc", r"(?:isc|internet systems consortium)", "isc|internet systems", False),
    ("zlib", r"zlib(?: libpng)?", "zlib", False),
    ("libpng", r"libpng", "libpng", False),
    ("boost-1", r"boost software license(?: version| v)?(?: 1 0)?", "boost", True),
    ("unlicense", r"(?:the unlicense|unlicense)", "unlicense", True),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl|do what the", True),
    ("cc0-1", r"(?:cc0|cc zero|creative commons zero)(?: version| v)?(?: 1 0)?(?: universal)?", "cc0|cc zero|creative commons", True),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)", "cc by|cc attribution|creative commons", True),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", "cc by|cc attribution|creative commons", True),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)", "cc by|cc attribution|creative commons", True),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s?(?: works)?)", "cc by|cc attribution|creative commons", True),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)", "cc by|cc attribution|creative commons", True),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc by|cc attribution|creative commons", True),
    ("cc", r"creative commons", "creative commons", False),
    ("odbl-1", r"(?:open database license|odbl)(?: version| v)?(?: ?1 0)?", "odbl|open database", True),
    ("odc-by-1", r"(?:open data commons attribution license|odc by)(?: version| v)?(?: 1 0)?", "odc|open data commons", True),
    ("pddl-1", r"(?:public domain dedication and license|pddl)(?: version| v)?(?: 1 0)?", "pddl|public domain dedication", True),
    ("ofl-1.1", r"(?:sil )?open font license(?: version| v)?(?: 1 1)?", "open font", True),
    ("python-2", r"(?:python software foundation license|psf license|psfl)(?: version| v)?(?: 2(?: 0)?)?", "python software|psf", True),
    ("php-3", r"php license(?: version| v)?(?: 3(?: 01| 0)?)?", "php", True),
    ("ruby", r"ruby", "ruby", False),
    ("postgresql", r"postgresql", "postgresql", False),
    ("openssl", r"openssl", "openssl", False),
    ("ms-pl", r"(?:microsoft public license|ms pl)", "microsoft|ms pl", True),
    ("ms-rl", r"(?:microsoft reciprocal license|ms rl)", "microsoft|ms rl", True),
    ("osl-3", r"(?:open software license|osl)(?: version| v)? ?3(?: 0)?", "osl|open software", True),
    ("afl-3", r"(?:academic free license|afl)(?: version| v)? ?3(?: 0)?", "afl|academic free", True),
    ("ncsa", r"(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa|illinois", False),
    ("bsl-1.1", r"(?:business source license|busl)(?: version| v)?(?: 1 1)?", "busl|business source", True),
    ("sspl-1", r"(?:server side public license|sspl)(?: version| v)?(?: 1(?: 0)?)?", "sspl|server side", True),
    ("elastic-2", r"elastic license(?: version| v)?(?: 2(?: 0)?)?", "elastic", True),
    ("public-domain", r"public domain", "public domain", False),
)

# Sentences of the license texts themselves, notices that stand in files, and addresses, as regexes over
# words, with the keyword that must occur. Earlier rules win where the intervals of two are equal.
_MIT = r"permission is hereby granted free of charge to any person obtaining a copy of this software and(?: its)? associated documentation files"
_BSD = r"redistribution and use in source and binary forms with or without modification are permitted"
_ISC = r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
_FSF = r"(?: as)? published by the free software foundation(?: either)? version "
_LATER = r"(?: of the license(?: or at your option any later version)?)?"
_SIGNATURES = (
    # Permissive texts
    ("mit-0", _MIT + r"(?: \S+){10,60}? furnished to do so the software is provided as is", "permission is hereby granted"),
    ("json", r"the software shall be used for good not evil", "good not evil"),
    ("ncsa", _MIT + r" the software to deal with the software without restriction", "permission is hereby granted"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium"),
    ("mit", _MIT, "permission is hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted"),
    ("apache-1.1", _BSD + r"(?: \S+){10,260}? products derived from this software may not be called apache", "redistribution and use"),
    ("php-3", _BSD + r"(?: \S+){10,120}? the name php must not be used to endorse", "redistribution and use"),
    ("openssl", _BSD + r"(?: \S+){10,120}? developed by the openssl project", "redistribution and use"),
    ("bsd-4-clause", _BSD + r"(?: \S+){10,120}? all advertising materials mentioning features or use of this software(?:(?: \S+){5,80}? (?:neither the names? of|may not be used to endorse or promote))?", "redistribution and use"),
    ("bsd-3-clause", _BSD + r"(?: \S+){10,120}? (?:neither the names? of|may not be used to endorse or promote)", "redistribution and use"),
    ("bsd-2-clause", _BSD, "redistribution and use"),
    ("0bsd", _ISC + r" the software is provided as is", "permission to use copy"),
    ("isc", _ISC + r" provided that the above copyright notice", "permission to use copy"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use copy"),
    ("hpnd", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee", "permission to use copy"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source"),
    ("libpng", r"the png reference library is supplied as is", "png reference library"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", r"you just do what the fuck you want to", "do what the"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "whatever you want"),
    ("blessing", r"may you do good and not evil may you find forgiveness for yourself and forgive others", "find forgiveness"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("ftl", r"portions of this software are copyright(?: c)?(?: \S+){0,2} the freetype project", "freetype project"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl project"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", "verbatim copies"),
    ("python-2", r"psf is making python available to licensee on an as is basis", "making python available"),
    ("python-2", r"this license agreement is between the python software foundation psf and the individual or organization", "python software foundation"),
    ("upl-1", r"the universal permissive license upl(?: version| v)? ?1 0", "universal permissive"),
    ("upl-1", r"to make use sell offer for sale import export have made and have sold the software and the larger work", "larger work"),
    ("ecl-2", r"licensed under the educational community license version 2 0", "educational community"),
    ("mulan-2", r"mulan psl v2", "mulan"),
    ("mulan-2", r"mulan permissive software license version 2", "mulan"),
    ("afl-3", r"licensed under the academic free license version 3 0", "academic free"),
    ("osl-3", r"licensed under the open software license version 3 0", "open software"),
    # Apache
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache-2", r"apache license version 2 0 january 2004", "apache license"),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements"),
    ("apache-2", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants to you"),
    ("apache-2", r"apache org licenses(?: license)? 2 0", "apache org licenses"),
    ("apache-1.1", r"apache org licenses license 1 1", "apache org licenses"),
    # GNU
    ("agpl-3", r"gnu affero general public license" + _FSF + "3" + _LATER, "affero"),
    ("lgpl-3", r"gnu lesser general public license" + _FSF + "3" + _LATER, "lesser general"),
    ("lgpl-2.1", r"gnu lesser general public license" + _FSF + "2 1" + _LATER, "lesser general"),
    ("lgpl-2", r"gnu (?:library|lesser) general public license" + _FSF + r"2(?! 1)" + _LATER, "library general|lesser general"),
    ("gpl-3", r"gnu general public license" + _FSF + "3" + _LATER, "general public"),
    ("gpl-2", r"gnu general public license" + _FSF + "2" + _LATER, "general public"),
    ("gpl-1", r"gnu general public license" + _FSF + "1" + _LATER, "general public"),
    ("agpl-3", r"gnu affero general public license version 3 19 november 2007", "affero"),
    ("lgpl-3", r"gnu lesser general public license version 3 29 june 2007", "lesser general"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999", "lesser general"),
    ("lgpl-2", r"gnu library general public license version 2 june 1991", "library general"),
    ("gpl-3", r"gnu general public license version 3 29 june 2007", "general public"),
    ("gpl-2", r"gnu general public license version 2 june 1991", "general public"),
    ("gpl-1", r"gnu general public license version 1 february 1989", "general public"),
    ("gpl-3", r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license", "take away your freedom"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license", "take away your freedom"),
    ("lgpl-2.1", r"the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses", "take away your freedom"),
    ("gfdl-1.3", r"copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", "free documentation"),
    ("gfdl-1.2", r"copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2", "free documentation"),
    ("gfdl-1.1", r"copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1", "free documentation"),
    ("agpl-3", r"gnu org licenses agpl(?: 3 0)?", "gnu org licenses"),
    ("lgpl-2.1", r"gnu org licenses(?: old licenses)? lgpl 2 1", "gnu org licenses"),
    ("lgpl-3", r"gnu org licenses lgpl 3 0", "gnu org licenses"),
    ("gpl-2", r"gnu org licenses(?: old licenses)? gpl 2 0", "gnu org licenses"),
    ("gpl-3", r"gnu org licenses gpl 3 0", "gnu org licenses"),
    ("lgpl", r"gnu org (?:licenses|copyleft) lgpl", "gnu org"),
    ("gpl", r"gnu org (?:licenses|copyleft) gpl", "gnu org"),
    ("gfdl", r"gnu org (?:licenses|copyleft) fdl", "gnu org"),
    # Weak copyleft of companies and foundations
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", "source code form"),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("mpl-2", r"mozilla org mpl 2 0", "mozilla org"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla public"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0", "mozilla public"),
    ("mpl-1.1", r"mozilla org mpl(?: mpl)? 1 1", "mozilla org"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license version 1 1", "netscape public"),
    ("epl-2", r"made available under the terms of the eclipse public license(?: v| version)? ?2 0", "eclipse public"),
    ("epl-1", r"made available under the terms of the eclipse public license(?: v| version)? ?1 0", "eclipse public"),
    ("epl-2", r"eclipse org legal epl (?:2 0|v20)", "eclipse org legal"),
    ("epl-1", r"eclipse org legal epl v10", "eclipse org legal"),
    ("cpl-1", r"the accompanying program is provided under the terms of this common public license", "common public"),
    ("ipl-1", r"the accompanying program is provided under the terms of this ibm public license", "ibm public"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license", "common development"),
    ("ms-rl", r"microsoft reciprocal license ms rl this license governs use of the accompanying software", "reciprocal license"),
    ("ms-pl", r"microsoft public license ms pl this license governs use of the accompanying software", "microsoft public"),
    ("eupl-1.2", r"licensed under the eupl(?: version| v)? ?1 2", "eupl"),
    ("cecill-2.1", r"(?:governed by|subject to|under) the cecill(?: free software)? license(?: version)? 2 1", "cecill"),
    ("cecill", r"governed by the cecill(?: [bc])? license under french law", "cecill"),
    ("lppl-1.3", r"this work may be distributed and or modified under the conditions of the latex project public license either version 1 3", "latex project public"),
    ("lppl", r"latex project org lppl", "latex project"),
    ("artistic-1", r"the copyright holder maintains some semblance of artistic control over the development of the package", "artistic control"),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "given free software package"),
    ("sspl-1", r"server side public license version 1 october 16 2018", "server side"),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensed work"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    # Works, data, fonts
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc-by", r"creativecommons org licenses by(?: [1-4] [0-9])?", "creativecommons org"),
    ("cc0-1", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons org"),
    ("public-domain", r"creativecommons org publicdomain mark(?: 1 0)?", "creativecommons org"),
    ("cc0-1", r"the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work"),
    ("cc0-1", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright", "affirmer"),
    ("public-domain", r"(?:has been|is hereby|are hereby) (?:placed in|released into|dedicated to) the public domain", "public domain"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "font software"),
    ("ofl-1.1", r"(?:scripts sil org|openfontlicense org)(?: ofl)?", "sil org|openfontlicense"),
    ("odbl-1", r"opendatacommons org licenses odbl(?: 1 0)?", "opendatacommons org"),
    ("odc-by-1", r"opendatacommons org licenses by(?: 1 0)?", "opendatacommons org"),
    ("pddl-1", r"opendatacommons org licenses pddl(?: 1 0)?", "opendatacommons org"),
)
# What only looks like a license. An interval of these suppresses what lies in it and gives no label.
_LOOKALIKES = (
    (r"(?:\S+ ){0,2}licen[cs]e (?:plates?|numbers?|fees?|holders?|office|tags?)", "licen"),
    (r"(?:\S+ ){0,2}licen[cs]e of (?:the|a|this) (?:city|state|county|town|driver|shop|bar|pub|restaurant|doctor|pilot)", "licen"),
    (r"(?:driver s?|drivers|driving|fishing|hunting|marriage|liquor|pilot s?|business|broadcasting|television|medical|artistic) licen[cs]e(?! [0-9]| version| v[0-9])", "licen"),
    (r"not (?:been |be )?(?:licensed|released|distributed|available|published|covered) under (?:\S+ ){0,6}?licen[cs]es?", "not"),
    (r"(?:not|nor|never) (?:\S+ ){0,2}?(?:placed in|released into|dedicated to|in) the public domain", "public domain"),
)

# How a name is used: priority (lower wins), what precedes and follows it, and the confidence of a detection. Where a
# group is marked, only what it holds is the interval.
_USES = (
    (2, r"spdx license identifier {name}(?: only| or later)?", 1.0),
    (2, r"spdx license identifier (?:\S+ ){{1,12}}?(?:or|and) ({name})(?: only| or later)?", 1.0),
    (3, r"(?:opensource|spdx|choosealicense) (?:org|com) licenses? {name}", 0.9),
    (3, r"(?:licensed|licenced|released|distributed|available|published|provided|covered|made available)(?: \S+){{0,3}}? (?:under|by the terms of|by the conditions of)"
        r"(?: the)?(?: terms| conditions)?(?: of)?(?: the| a| an)? {name}(?: licen[cs]e)?(?: or later)?", 0.95),
    (4, r"(?:the )?{name} licen[cs]e(?:d)?", 0.8),
    (5, r"licen[cs]e(?: is| type| name)? (?:the )?{name}", 0.7),
    (6, r"{name}", 0.5),
)
#: One of these occurs in every text in which a rule can match.
_ANCHORS = (b"licen", b"spdx", b"gpl", b"creative commons", b"cc by", b"cc attribution", b"cc0", b"cc zero", b"public domain", b"mpl", b"epl",
            b"cddl", b"cpl", b"eupl", b"bsd", b"apache", b"mozilla", b"wtfpl", b"gfdl", b"odbl", b"odc by", b"pddl",
            b"psfl", b"ms pl", b"ms rl", b"osl", b"afl", b"busl", b"sspl", b"released", b"distributed", b"available",
            b"published", b"provided", b"covered", b"mit 0", b"mit no attribution",
            *sorted({keyword.encode() for _, _, keywords in _SIGNATURES for keyword in keywords.split("|")}))


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    confidence: float


def signature_rules() -> list[Rule]:
    """All rules in the order in which they are tried: look-alikes, which have no label, then texts, notices and addresses,
    then names by use and in their own order."""
    whole = lambda text: re.compile((r"(?<!\S)" + text + r"(?!\S)").encode())
    gates = lambda keywords: tuple(k.encode() for k in keywords.split("|"))
    rules = [Rule(0, "", gates(keywords), whole(text), 0.0) for text, keywords in _LOOKALIKES]
    rules += [Rule(1, label, gates(keywords), whole(text), 0.98) for label, text, keywords in _SIGNATURES]
    for priority, use, confidence in _USES:
        for label, name, keywords, alone in _NAMES:
            if alone or use != r"{name}":
                rules.append(Rule(priority, label, gates(keywords), whole(use.format(name=name)), confidence))
    return rules


# A word is a run of letters, digits and all characters beyond ASCII; what is left becomes one space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text with A-Z in lower case."""
    return text.translate(_TO_WORDS).split()


def base_places(joined: bytes) -> list[tuple[int, bytes, str]]:
    """Place in bytes, phrase and label of every place where a base phrase's words stand one after the other. `joined`
    holds the words between single spaces, with one at either end."""
    found = []
    for phrase, label in BASE_PHRASES:
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            found.append((at, needle, label))
            at = joined.find(needle, at + 1)
    return found


def detections(joined: bytes, rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Start and end in bytes of the joined words, and the rule, after suppression; look-alikes are left out."""
    if not any(anchor in joined for anchor in _ANCHORS):
        return []
    known: dict[bytes, bool] = {}
    found = []
    for order, rule in enumerate(rules):
        if any(known[k] if k in known else known.setdefault(k, k in joined) for k in rule.keywords):
            for m in rule.pattern.finditer(joined):
                start, end = m.span(m.lastindex or 0)
                found.append((rule.priority, start - end, start, order, end, rule))
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of the kept intervals that no other kept one contains: both rise together
    ends: list[int] = []
    for _, _, start, _, end, rule in sorted(found, key=lambda x: x[:4]):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:max(low, high)], ends[low:max(low, high)] = [start], [end]
    return sorted((found for found in kept if found[2].label), key=lambda x: x[:2])


_OUT = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()),
                                       ("priority", pa.int32())]))),
])


def scan_text(text: bytes, rules: list[Rule]) -> dict:
    """All results for one text. A word position counts from 0; end_word is exclusive."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    kept = detections(joined, rules)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  spaces before a place in bytes
    places = [word(at) for at, _, _ in base]
    base_labels = sorted({label for _, _, label in base})
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": base_labels, "labels": sorted({*base_labels, *(rule.label for _, _, rule in kept)}),
        "score": max([0.0, *(rule.confidence for _, _, rule in kept), *(0.95 for _ in base)]),
        "detections": [{"start_word": word(a) - 1, "end_word": word(b), "label": rule.label, "priority": rule.priority} for a, b, rule in kept],
    }


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every whole text.

    A null text counts as empty: no words, no labels, score 0, null first_word and last_word. Only the two named
    columns are read, so others may have any name. Repeated rows stay repeated."""
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = signature_rules()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [scan_text(t.as_py() or b"", rules) for t in texts]
            columns = [pa.array([row[f.name] for row in rows], f.type) for f in _OUT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_OUT.names])

    fields = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, "
              "score double, detections array<struct<start_word: bigint, end_word: bigint, label: string, priority: int>>")
    picked = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return picked.mapInArrow(scan, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
