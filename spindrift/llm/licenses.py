"""Licence detection by ordered signature rules.

Rules are regular expressions over the normalised words of a text, in priority order: the rules of
licences with a version and then of those without (each from the SPDX line over the ways of use to the
bare name), then signatures of licence texts and notices, then the base phrases. A rule is tried only where the text holds, as a whole word,
one of the rule's keywords; every text that a rule can match holds one, as the keywords are taken from
all that its pattern spells, so the gate loses nothing. Detections are taken by priority, then the
longer first, then the leftmost; one that lies inside a detection taken before, or overlaps it, is
suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts

# The phrases of the base labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Label, how texts name the licence, and its code. Words are lower-case runs of letters and
# digits, so "GPL-2.0-only" reads "gpl 2 0 only".
NAMES = """
agpl-3.0|(?:gnu )?affero (?:gpl|general public licen[sc]e) (?:v|version )?3(?: 0)?|agpl v?3(?: 0)?
agpl|(?:gnu )?affero (?:gpl|general public licen[sc]e)|agpl
lgpl-2.1|(?:gnu )?(?:lesser|library) (?:gpl|general public licen[sc]e) (?:v|version )?2 1|lgpl v?2 1
lgpl-2.0|(?:gnu )?(?:lesser|library) (?:gpl|general public licen[sc]e) (?:v|version )?2(?: 0)?|lgpl v?2(?: 0)?
lgpl-3.0|(?:gnu )?(?:lesser|library) (?:gpl|general public licen[sc]e) (?:v|version )?3(?: 0)?|lgpl v?3(?: 0)?
lgpl|(?:gnu )?(?:lesser|library) (?:gpl|general public licen[sc]e)|lgpl
gpl-1.0|(?:gnu )?(?:gpl|general public licen[sc]e) (?:v|version )?1(?: 0)?|gpl v?1(?: 0)?
gpl-2.0|(?:gnu )?(?:gpl|general public licen[sc]e) (?:v|version )?2(?: 0)?|gpl v?2(?: 0)?
gpl-3.0|(?:gnu )?(?:gpl|general public licen[sc]e) (?:v|version )?3(?: 0)?|gpl v?3(?: 0)?
gpl-any|gnu (?:gpl|general public licen[sc]e)|gnu gpl
gfdl|(?:gnu )?free documentation licen[sc]e|gfdl
apache-1.1|apache (?:software )?licen[sc]e (?:v|version )?1 1|apache 1 1
apache-2.0|apache (?:software )?licen[sc]e (?:v|version )?2(?: 0)?|apache 2 0
apache|apache (?:software )?licen[sc]e|apache
mit-0|mit no attribution(?: licen[sc]e)?|mit 0
mit-expat|expat(?: mit)? licen[sc]e|expat
x11|(?:mit )?x11 licen[sc]e|x11
mit|(?:the )?mit licen[sc]e|mit
isc|isc licen[sc]e|isc
bsd-2-clause|(?:simplified|freebsd|two clause|2 clause) bsd(?: licen[sc]e)?|bsd 2 clause
bsd-3-clause|(?:new|modified|revised|three clause|3 clause) bsd(?: licen[sc]e)?|bsd 3 clause
bsd-4-clause|(?:original|four clause|4 clause) bsd(?: licen[sc]e)?|bsd 4 clause
bsd-0-clause|zero clause bsd(?: licen[sc]e)?|0bsd
bsd|(?:berkeley software distribution|bsd)(?: style| type)? licen[sc]e|bsd
mpl-1.0|mozilla public licen[sc]e (?:v|version )?1 0|mpl 1 0
mpl-1.1|mozilla public licen[sc]e (?:v|version )?1 1|mpl 1 1
mpl-2.0|mozilla public licen[sc]e (?:v|version )?2(?: 0)?|mpl 2 0
mpl|mozilla public licen[sc]e|mpl
epl-1.0|eclipse public licen[sc]e (?:v|version )?1(?: 0)?|epl 1 0
epl-2.0|eclipse public licen[sc]e (?:v|version )?2(?: 0)?|epl 2 0
edl-1.0|eclipse distribution licen[sc]e|edl
cddl-1.0|common development and distribution licen[sc]e|cddl
cpl-1.0|common public licen[sc]e|cpl
ipl-1.0|ibm public licen[sc]e|ipl
eupl-1.2|european union public licen[sc]e|eupl
cecill|cecill(?: [bc])? (?:free software )?licen[sc]e|cecill
artistic-1.0|artistic licen[sc]e 1 0|artistic 1 0
artistic-2.0|artistic licen[sc]e 2(?: 0)?|artistic 2 0
artistic|(?:perl )?artistic licen[sc]e|artistic
bsl-1.0|boost software licen[sc]e|bsl 1 0
zlib|zlib(?: libpng)? licen[sc]e|zlib
libpng|libpng licen[sc]e|libpng
unlicense|the unlicense|unlicense
wtfpl|do what the fuck you want to public licen[sc]e|wtfpl
cc0-1.0|(?:creative commons )?cc0(?: 1 0)?(?: universal)?|cc0 1 0
cc-by-4.0|creative commons attribution (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by 4 0
cc-by-3.0|creative commons attribution (?:v|version )?3(?: 0)?(?: unported)?(?: licen[sc]e)?|cc by 3 0
cc-by-sa-4.0|creative commons attribution share ?alike (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by sa 4 0
cc-by-sa-3.0|creative commons attribution share ?alike (?:v|version )?3(?: 0)?(?: unported)?(?: licen[sc]e)?|cc by sa 3 0
cc-by-nc-4.0|creative commons attribution non ?commercial (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by nc 4 0
cc-by-nd-4.0|creative commons attribution no ?deriv(?:ative)?s (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by nd 4 0
cc-by-nc-sa-4.0|creative commons attribution non ?commercial share ?alike (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by nc sa 4 0
cc-by-nc-nd-4.0|creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:v|version )?4(?: 0)?(?: international)?(?: licen[sc]e)?|cc by nc nd 4 0
cc-by-nc-sa|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?|cc by nc sa
cc-by-nc-nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?|cc by nc nd
cc-by-sa|creative commons attribution share ?alike(?: licen[sc]e)?|cc by sa
cc-by-nc|creative commons attribution non ?commercial(?: licen[sc]e)?|cc by nc
cc-by-nd|creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?|cc by nd
cc-by|creative commons attribution(?: licen[sc]e)?|cc by
ofl-1.1|(?:sil )?open font licen[sc]e|ofl 1 1
odbl-1.0|open (?:data commons open )?database licen[sc]e|odbl
odc-by-1.0|open data commons attribution licen[sc]e|odc by
pddl-1.0|public domain dedication and licen[sc]e|pddl
python-2.0|python(?: software foundation)? licen[sc]e|psf 2 0
php-3.01|php licen[sc]e|php 3 01
ruby|ruby licen[sc]e|ruby
openssl|openssl licen[sc]e|openssl
w3c|w3c software(?: notice and)? licen[sc]e|w3c
ms-pl|microsoft public licen[sc]e|ms pl
ms-rl|microsoft reciprocal licen[sc]e|ms rl
ncsa|(?:university of illinois ncsa )?open source licen[sc]e ncsa|ncsa
postgresql|postgresql licen[sc]e|postgresql
afl-3.0|academic free licen[sc]e|afl 3 0
osl-3.0|open software licen[sc]e|osl 3 0
qpl-1.0|q public licen[sc]e|qpl
sspl-1.0|server side public licen[sc]e|sspl
busl-1.1|business source licen[sc]e|busl
elastic-2.0|elastic licen[sc]e|elastic 2 0
upl-1.0|universal permissive licen[sc]e|upl
hpnd|historical permission notice and disclaimer|hpnd
ftl|freetype(?: project)? licen[sc]e|ftl
icu|icu licen[sc]e|icu
vim|vim licen[sc]e|vim
"""
# Label and signature of a licence's text, of its notice or of another statement of rights.
SIGNATURES = """
mit|permission is hereby granted free of charge to any person obtaining a copy
mit|to deal in the software without restriction including without limitation the rights
mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|the above copyright notice and this permission notice (?:including the next paragraph )?shall be included
mit|in no event shall the authors or copyright holders be liable for any claim
mit|dual licen[sc]ed under the mit and
mit-0|without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11|except as contained in this notice the name of the x consortium shall not be used in advertising
x11|the name of the copyright holders shall not be used in advertising or otherwise to promote the sale
isc|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc|provided that the above copyright notice and this permission notice appear in all copies
isc|the author disclaims all warranties with regard to this software including all implied warranties
hpnd|permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd|not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
bsd|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions of source code must retain the above copyright notice
bsd|redistributions in binary form must reproduce the above copyright notice
bsd|use of this source code is governed by a bsd style licen[sc]e
bsd|can be found in the bsd licen[sc]e file
bsd-3-clause|neither the name of (?:the )?(?:copyright holder|author|project|university|organi[sz]ation|regents) nor the names of its contributors may be used to endorse or promote
bsd-3-clause|the names? of (?:its|the) contributors may not be used to endorse or promote products
bsd-4-clause|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause|this product includes software developed by the university of california
bsd-2-clause|the views and conclusions contained in the software and documentation are those of the authors
bsd-0-clause|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
apache-1.1|this product includes software developed by the apache software foundation
apache-1.1|products derived from this software may not be called apache
apache-2.0|you may not use this file except in compliance with the licen[sc]e
apache-2.0|you may obtain a copy of the licen[sc]e at http www apache org licen[sc]es licen[sc]e 2 0
apache-2.0|www apache org licen[sc]es licen[sc]e 2 0
apache-2.0|unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0|terms and conditions for use reproduction and distribution
apache-2.0|licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache-2.0|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
apache-2.0|see the notice file distributed with this work for additional information regarding copyright ownership
apache-2.0|apache licen[sc]e 2 0 or mit
gpl|this (?:program|library|software|file|package) is free software you (?:can|may) redistribute it and or modify it
gpl|under the terms of the gnu general public licen[sc]e
gpl|as published by the free software foundation
gpl|you should have received a copy of the gnu general public licen[sc]e along with this program
gpl|if not write to the free software foundation inc
gpl|51 franklin street fifth floor boston
gpl|59 temple place suite 330 boston
gpl|675 mass ave cambridge
gpl|www gnu org licen[sc]es
gpl|this program is distributed in the hope that it will be useful but without any warranty
gpl|the licen[sc]es for most software are designed to take away your freedom to share and change it
gpl|everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed
gpl|comes with absolutely no warranty for details type show w
gpl|may be distributed under the terms of the gpl
gpl-2.0|either version 2 of the licen[sc]e or at your option any later version
gpl-2.0|gnu general public licen[sc]e version 2 june 1991
gpl-2.0|gplv2
gpl-2.0|gpl 2 0 (?:only|or later)
gpl-2.0|www gnu org licen[sc]es old licen[sc]es gpl 2 0
gpl-2.0|this general public licen[sc]e does not permit incorporating your program into proprietary programs
gpl-2.0|as published by the free software foundation version 2
gpl-3.0|either version 3 of the licen[sc]e or at your option any later version
gpl-3.0|gnu general public licen[sc]e version 3 29 june 2007
gpl-3.0|gplv3
gpl-3.0|gpl 3 0 (?:only|or later)
gpl-3.0|to protect your rights we need to prevent others from denying you these rights or asking you to surrender the rights
gpl-3.0|the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl-3.0|installation information for a user product means any methods procedures authorization keys
gpl-1.0|either version 1 or at your option any later version
gpl-classpath|as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-linking|as a special exception if you link this (?:library|file) with other (?:files|modules)
lgpl|you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
lgpl|under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl|a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl-2.1|either version 2 1 of the licen[sc]e or at your option any later version
lgpl-2.1|gnu lesser general public licen[sc]e version 2 1 february 1999
lgpl-2.1|lgplv2 1
lgpl-2.0|gnu library general public licen[sc]e version 2 june 1991
lgpl-3.0|this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3
lgpl-3.0|lgplv3
agpl-3.0|gnu affero general public licen[sc]e version 3 19 november 2007
agpl-3.0|you should have received a copy of the gnu affero general public licen[sc]e
agpl-3.0|interacting with it remotely through a computer network
agpl-3.0|agplv3
agpl-3.0|remote network interaction use with the gnu general public licen[sc]e
gfdl|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl|with no invariant sections no front cover texts and no back cover texts
gfdl|a copy of the licen[sc]e is included in the section entitled gnu free documentation licen[sc]e
mpl-1.1|the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-1.1|software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e for the specific language governing rights
mpl-1.1|www mozilla org mpl
mpl-2.0|this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0|if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0|this source code form is incompatible with secondary licen[sc]es
mpl-2.0|mozilla org mpl 2 0
epl-1.0|the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0
epl-2.0|the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0
epl-1.0|www eclipse org legal epl v10
epl-2.0|www eclipse org legal epl 2 0
edl-1.0|www eclipse org org documents edl v10
cddl-1.0|the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl-1.0|when distributing covered code include this cddl header in each file
cddl-1.0|you can obtain a copy of the licen[sc]e at (?:usr src )?opensolaris licen[sc]e
cpl-1.0|the accompanying materials are made available under the terms of the common public licen[sc]e
eupl-1.2|licen[sc]ed under the eupl
eupl-1.2|joinup ec europa eu
cecill|this software is governed by the cecill
cecill|ce logiciel est régi par la licence cecill
cecill|www cecill info
artistic|the intent of this document is to state the conditions under which a package may be copied
artistic|you may redistribute it and or modify it under the same terms as perl itself
artistic|under the same terms as (?:the )?perl ?5? (?:itself|programming language)
artistic-2.0|this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed
bsl-1.0|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0|www boost org licen[sc]e 1 0
bsl-1.0|distributed under the boost software licen[sc]e
zlib|altered source versions must be plainly marked as such
zlib|the origin of this software must not be misrepresented
zlib|in no event will the authors be held liable for any damages arising from the use of this software
zlib|permission is granted to anyone to use this software for any purpose including commercial applications
libpng|the png reference library is supplied as is
unlicense|this is free and unencumbered software released into the public domain
unlicense|anyone is free to copy modify publish use compile sell or distribute this software
unlicense|in jurisdictions that recognize copyright laws the author or authors of this software dedicate
unlicense|unlicense org
wtfpl|you just do what the fuck you want to
wtfpl|www wtfpl net
cc0-1.0|creativecommons org publicdomain zero 1 0
cc0-1.0|has waived all copyright and related or neighboring rights
cc-by-4.0|creativecommons org licen[sc]es by 4 0
cc-by-3.0|creativecommons org licen[sc]es by 3 0
cc-by-sa-4.0|creativecommons org licen[sc]es by sa 4 0
cc-by-sa-3.0|creativecommons org licen[sc]es by sa 3 0
cc-by-nc-4.0|creativecommons org licen[sc]es by nc 4 0
cc-by-nd-4.0|creativecommons org licen[sc]es by nd 4 0
cc-by-nc-sa-4.0|creativecommons org licen[sc]es by nc sa 4 0
cc-by-nc-nd-4.0|creativecommons org licen[sc]es by nc nd 4 0
cc-by-sa|text is available under the creative commons attribution share ?alike
cc-by|this work is licen[sc]ed under a creative commons
cc-by|some rights reserved
ofl-1.1|this font software is licen[sc]ed under the sil open font licen[sc]e
ofl-1.1|with reserved font name
ofl-1.1|scripts sil org ofl
odbl-1.0|opendatacommons org licen[sc]es odbl
odbl-1.0|contains information from (?:the )?openstreetmap
odc-by-1.0|opendatacommons org licen[sc]es by
pddl-1.0|opendatacommons org licen[sc]es pddl
python-2.0|this licen[sc]e agreement is between the python software foundation psf
python-2.0|psf is making python available to licen[sc]ee on an as is basis
php-3.01|this product includes php software freely available from
php-3.01|www php net licen[sc]e
ruby|you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl) or the conditions below
openssl|this product includes software developed by the openssl project for use in the openssl toolkit
openssl|this product includes cryptographic software written by eric young
w3c|by obtaining using and or copying this work you the licen[sc]ee agree that you have read understood and will comply
w3c|www w3 org consortium legal
ms-pl|this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
ncsa|developed by the university of illinois
ncsa|nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided as is
postgresql|in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
afl-3.0|licen[sc]ed under the academic free licen[sc]e
osl-3.0|licen[sc]ed under the open software licen[sc]e
qpl-1.0|may be distributed under the terms of the q public licen[sc]e
sspl-1.0|if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl-1.1|additional use grant
elastic-2.0|you may not provide the software to third parties as a hosted or managed service
upl-1.0|the universal permissive licen[sc]e
ftl|portions of this software are copyright (?:c )?[0-9]+ the freetype project
ftl|this software is based in part (?:of|on) the work of the freetype team
ijg|this software is based in part on the work of the independent jpeg group
icu|permission to use copy modify merge publish distribute and or sell copies of the software and to permit persons
curl|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
vim|vim is charityware
json|the software shall be used for good not evil
beerware|this beer in return
beerware|the beer ?ware licen[sc]e
public-domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain|public domain no copyright
public-domain|the author disclaims copyright to this source code
public-domain|may you do good and not evil
commons-clause|commons clause licen[sc]e condition
commons-clause|the licen[sc]e does not grant to you the right to sell the software
shareware|this is shareware
shareware|unregistered evaluation (?:copy|version)
freeware|this software is freeware
freeware|free for (?:personal|private|non ?commercial|educational) use
no-commercial|not for commercial (?:use|redistribution)
no-commercial|for non ?commercial (?:use|purposes) only
no-redistribution|may not be (?:copied|reproduced|redistributed) without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
no-redistribution|no part of this (?:publication|book|document|work) may be reproduced
proprietary|all rights reserved
proprietary|(?:proprietary and confidential|confidential and proprietary)
proprietary|unauthori[sz]ed (?:copying|use|reproduction) (?:of this file )?(?:via any medium )?is strictly prohibited
proprietary|this software contains confidential and trade secret information
proprietary|end user licen[sc]e agreement
proprietary|use of this software is subject to (?:the terms of )?(?:a|the|your) licen[sc]e agreement
trademark|(?:is|are) (?:a )?(?:registered )?trademarks? of
warranty|provided (?:by the copyright holders and contributors )?as is (?:and|without) (?:any )?(?:express|warranty)
warranty|without warranty of any kind
warranty|merchantability (?:and|or) fitness for a particular purpose
copyright|copyright (?:c )?(?:19|20)[0-9]{2}
spdx|spdx licen[sc]e identifier
"""
# How a name is used: template, score. The first that fits is the strongest. A code may be a plain word
# (ruby, vim, mit), so it needs more beside it than a name does.
USES = (
    ("spdx licen[sc]e identifier (?:{name}|{code})(?: only| or later)?", 1.0),
    ("(?:licen[sc]ed|released|distributed|available|covered|governed|provided) (?:(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?{name}|under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?{code})", 0.95),
    ("(?:this|the) (?:file|work|project|program|library|software|code|document) is (?:under (?:the )?(?:{name}|{code})|(?:the )?{name})", 0.9),
    ("licen[sc]e (?:(?:is |text )?(?:the )?{name}|(?:is )?{code})", 0.85),
    ("(?:{name}|{code}) licen[sc]ed?", 0.8),
    ("{name}", 0.7),
)
# Words that are no good keywords, as many texts hold them.
_COMMON = frozenset("license licence licensed licenced licenses licences public the software general free under terms version project program document permission copyright and source file foundation".split())


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    keywords: frozenset[str]
    pattern: re.Pattern
    score: float


def spelled(pattern: str) -> set[str]:
    """All texts that a pattern of words, (?:a|b), [sc], x?, and [0-9] with a count can match; a digit reads NUL."""

    def several(at: int) -> tuple[set[str], int]:
        every, now = set(), {""}
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                every, now, at = every | now, {""}, at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = several(at + 3)
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = ({"\0"} if "-" in pattern[at:end] else set(pattern[at + 1 : end])), end + 1
                if m := re.compile(r"\{[0-9]+\}|\+").match(pattern, at):
                    at = m.end()
            else:
                part, at = {pattern[at]}, at + 1
            if pattern.startswith("?", at):
                part, at = part | {""}, at + 1
            now = {a + b for a in now for b in part}
        return every | now, at

    return several(0)[0]


def keywords(pattern: str) -> frozenset[str]:
    """Words of which every text that the pattern matches holds one: of each spelling the longest rare one."""
    found = set()
    for text in spelled(pattern):
        words = [w for w in text.split() if "\0" not in w]
        found.add(max(words, key=lambda w: (w not in _COMMON, len(w), w)))
    return frozenset(found)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in priority order: licences with a version, then those without, each from the strongest use to the bare name; signatures; base phrases."""
    rows = []
    parts = [x.split("|", 1) for x in NAMES.strip().splitlines()]
    split = [(label, *rest.rsplit("|", 1)) for label, rest in parts]
    for versioned in (True, False):
        for template, score in USES:
            for label, name, code in split:
                if versioned == any(c.isdigit() for c in label.partition("-")[2]):
                    keys = keywords(name) | (keywords(code) if "{code}" in template else frozenset())
                    rows.append((label, keys, template.replace("{name}", f"(?:{name})").replace("{code}", f"(?:{code})"), score))
    for line in SIGNATURES.strip().splitlines():
        label, words = line.split("|", 1)
        rows.append((label, keywords(words), words, 0.9))
    rows += [(label, keywords(words), words, 0.75) for label, words in BASE]
    return tuple(Rule(i, label, keys, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])"), score) for i, (label, keys, p, score) in enumerate(rows))


@lru_cache(1)
def _by_keyword() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        for w in r.keywords:
            out.setdefault(w.encode(), []).append(r)
    return out


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str) -> list[bytes]:
    """Lower-case words: runs of letters a-z, digits and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left of (from, to, rule) when what overlaps one of an earlier rule is suppressed, by place."""
    found.sort(key=lambda x: (x[2].order, x[0] - x[1], x[0]))
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for x in found:
        i = bisect_left(starts, x[1])  # those before i begin ahead of its end
        if not i or kept[i - 1][1] <= x[0]:
            starts.insert(i, x[0])
            kept.insert(i, x)
    return kept


def detect(words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """(first word, end word, label, score) of what rules find and suppression leaves, by place."""
    by_word = _by_keyword()
    tried = {r.order: r for w in by_word.keys() & set(words) for r in by_word[w]}
    if not tried:
        return []
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    out, at, word = [], 0, 0
    for a, b, r in resolve([(m.start(), m.end(), r) for r in tried.values() for m in r.pattern.finditer(joined)]):
        word += joined.count(" ", at, a)
        at = a
        out.append((word, word + joined.count(" ", a, b) + 1, r.label, r.score))
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every base phrase."""
    out = []
    for label, phrase in BASE:
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return sorted(out)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.string()))])


def scan(text: str) -> tuple:
    words = normalise(text)
    base = base_places(words)
    found = detect(words)
    names = sorted({x[1] for x in base})
    every = sorted({*names, *(x[2] for x in found)})
    score = max([0.75 * bool(base), *(x[3] for x in found)], default=0.0)
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names), ",".join(every), score, [f"{x[2]}:{x[0]}:{x[1]}" for x in found])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        columns = [list(c) for c in zip(*map(scan, texts(rows.column("text"))), strict=True)] or [[]] * 8
        yield batch(_OUT, doc_id=rows.column("doc_id"), **dict(zip(_OUT.names[1:], columns, strict=True)))


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence labels of every row of ``docs`` (doc_id, text), found over the whole text.

    n_words, n_base (places of base phrases), first_word, last_word (null without one), base_labels,
    labels, score, detections (label:first word:end word). A null or empty text has no words and no
    labels; a null doc_id is passed on; repeated rows come back repeated; no rows, no rows.
    """
    return map_arrow(docs.select("doc_id", "text"), _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")
