"""The signature rules of the license scan.

A rule is a regular expression over a text's words (lower case, one space between). Its ``@`` stands
before the keyword that gates it: the rule is tried only where that word occurs. Rules are ordered;
a greater priority wins over a smaller one, and of equal ones the longer match, then the earlier rule.

Priorities: 4 identifiers and addresses, 3 full names with their version, 2 names without one and
sentences of a license's own text, 1 general hints.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Words of the identifier after "SPDX-License-Identifier:", and the label.
IDENTIFIERS = """
mit: mit; mit 0: mit-0; x11: x11; apache 2 0: apache-2; apache 1 1: apache-1.1; apache 1 0: apache-1
bsd 2 clause: bsd-2-clause; bsd 3 clause: bsd-3-clause; bsd 4 clause: bsd-4-clause; 0bsd: 0bsd; isc: isc; zlib: zlib; bsl 1 0: boost-1
gpl 1 0(?: only| or later)?: gpl-1; gpl 2 0(?: only| or later)?: gpl-2; gpl 3 0(?: only| or later)?: gpl-3
lgpl 2 0(?: only| or later)?: lgpl-2; lgpl 2 1(?: only| or later)?: lgpl-2.1; lgpl 3 0(?: only| or later)?: lgpl-3
agpl 1 0(?: only| or later)?: agpl-1; agpl 3 0(?: only| or later)?: agpl-3
gfdl 1 1(?: only| or later)?: gfdl-1.1; gfdl 1 2(?: only| or later)?: gfdl-1.2; gfdl 1 3(?: only| or later)?: gfdl-1.3
mpl 1 0: mpl-1; mpl 1 1: mpl-1.1; mpl 2 0: mpl-2; epl 1 0: epl-1; epl 2 0: epl-2; cpl 1 0: cpl-1
cddl 1 0: cddl-1; cddl 1 1: cddl-1.1; eupl 1 1: eupl-1.1; eupl 1 2: eupl-1.2; cecill 2 1: cecill-2.1; cecill b: cecill-b; cecill c: cecill-c
artistic 1 0: artistic-1; artistic 2 0: artistic-2; afl 3 0: afl-3; osl 3 0: osl-3; ecl 2 0: ecl-2
unlicense: unlicense; wtfpl: wtfpl; beerware: beerware; json: json; openssl: openssl; php 3 01: php-3.01; python 2 0: python-2; psf 2 0: psf-2
ncsa: ncsa; postgresql: postgresql; ruby: ruby; vim: vim; w3c: w3c; unicode dfs 2016: unicode; unicode 3 0: unicode; ms pl: ms-pl; ms rl: ms-rl
ofl 1 0: ofl-1; ofl 1 1: ofl-1.1; odbl 1 0: odbl-1; odc by 1 0: odc-by-1; pddl 1 0: pddl-1; cdla permissive 2 0: cdla-permissive-2; cdla sharing 1 0: cdla-sharing-1
cc0 1 0: cc0; cc by [1-4] [05]: cc-by; cc by sa [1-4] [05]: cc-by-sa; cc by nd [1-4] [05]: cc-by-nd
cc by nc [1-4] [05]: cc-by-nc; cc by nc sa [1-4] [05]: cc-by-nc-sa; cc by nc nd [1-4] [05]: cc-by-nc-nd
busl 1 1: busl-1.1; sspl 1 0: sspl-1; elastic 2 0: elastic-2; polyform noncommercial 1 0 0: polyform-noncommercial; upl 1 0: upl-1; mulanpsl 2 0: mulan-2; blueoak 1 0 0: blueoak-1
"""

#: A label, then its rules: priority and expression.
SIGNATURES = """
mit
4 opensource org (?:licen[cs]e|licenses) @mit
4 choosealicense com licenses @mit
3 (?:under |with )?(?:the )?@mit licen[cs]e
3 (?:under |with )?(?:the )?@expat licen[cs]e
3 (?:license|licensed|licence) (?:under )?(?:the )?@mit
2 @mit (?:style|like|type) licen[cs]e
2 @mit licensed
2 permission is hereby @granted free of charge to any person obtaining a copy
2 the above @copyright notice and this permission notice shall be included in all copies
mit-0
4 github com aws @mit 0
3 @mit no attribution(?: licen[cs]e)?
3 @mit 0 licen[cs]e
x11
3 @x11 licen[cs]e
3 @mit x11 licen[cs]e
2 @x consortium licen[cs]e
apache-2
4 apache org licenses @license 2 0(?: txt| html)?
4 opensource org (?:license|licenses) @apache 2 0(?: php)?
4 choosealicense com licenses @apache 2 0
3 (?:under |with )?(?:the )?@apache (?:software )?(?:foundation )?licen[cs]e (?:version |v ?)?2(?: 0)?
3 (?:the )?@apache licen[cs]e v2(?: 0)?
3 @apache 2(?: 0)? licen[cs]e
3 @asl (?:version )?2(?: 0)?
2 @apache v?2 licensed
2 (?:license|licensed) (?:under )?(?:the )?@apache 2(?: 0)?
2 @apachev2
apache-1.1
3 (?:the )?@apache (?:software )?licen[cs]e (?:version )?1 1
4 apache org licenses @license 1 1
apache-1
3 (?:the )?@apache (?:software )?licen[cs]e (?:version )?1 0
4 apache org licenses @license 1 0
apache
1 (?:the )?@apache (?:software )?(?:foundation )?licen[cs]e
bsd-2-clause
4 opensource org (?:license|licenses) @bsd 2 clause
3 @bsd 2 clause(?: simplified)?(?: licen[cs]e)?
3 (?:2|two) clause @bsd(?: licen[cs]e)?
3 (?:the )?simplified @bsd licen[cs]e
3 (?:the )?@freebsd licen[cs]e
bsd-3-clause
4 opensource org (?:license|licenses) @bsd 3 clause
3 @bsd 3 clause(?: new| revised)?(?: licen[cs]e)?
3 (?:3|three) clause @bsd(?: licen[cs]e)?
3 (?:the )?(?:new|revised|modified) @bsd licen[cs]e
2 neither the name of .{1,60} nor the names of its @contributors may be used to endorse or promote
bsd-4-clause
3 @bsd 4 clause(?: original)?(?: licen[cs]e)?
3 (?:4|four) clause @bsd(?: licen[cs]e)?
3 (?:the )?original @bsd licen[cs]e
2 all @advertising materials mentioning features or use of this software must display
0bsd
3 (?:zero|0) clause @bsd(?: licen[cs]e)?
3 @bsd zero clause licen[cs]e
bsd
2 @bsd licensed
1 (?:the )?@bsd (?:style )?licen[cs]e
1 @redistribution and use in source and binary forms with or without modification are permitted
isc
4 opensource org (?:license|licenses) @isc
3 (?:the )?@isc licen[cs]e
2 permission to use copy modify and or @distribute this software for any purpose with or without fee
zlib
4 opensource org (?:license|licenses) @zlib
3 (?:the )?@zlib (?:libpng )?licen[cs]e
2 altered source versions must be plainly @marked as such
boost-1
4 boost org @license 1 0(?: txt)?
3 (?:the )?@boost software licen[cs]e(?: version)?(?: 1 0)?
gpl-1
3 @gnu general public licen[cs]e (?:version |v ?)1(?: 0)?
3 @gplv1
gpl-2
4 gnu org licenses (?:old licenses )?@gpl 2 0(?: html| txt)?
4 opensource org (?:license|licenses) @gpl 2 0
3 (?:the )?@gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?2(?: 0)?(?: or (?:later|any later version))?
3 (?:the )?@gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2
3 @gnu gpl v2
3 @gplv2
3 @gpl (?:version |v ?)?2(?: 0)?(?: or later)?
3 @gpl v2
3 @gpl2
2 version 2 of the @gnu general public licen[cs]e
2 version 2 of the @gpl
gpl-3
4 gnu org licenses @gpl 3 0(?: html| txt)?
4 opensource org (?:license|licenses) @gpl 3 0
3 (?:the )?@gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?(?: or (?:later|any later version))?
3 (?:the )?@gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3
3 @gnu gpl v3
3 @gplv3
3 @gpl (?:version |v ?)?3(?: 0)?(?: or later)?
3 @gpl v3
3 @gpl3
2 version 3 of the @gnu general public licen[cs]e
2 version 3 of the @gpl
gpl
4 gnu org licenses @gpl(?: html| txt)?
2 (?:the )?@gnu general public licen[cs]e
2 (?:the )?@gnu gpl
1 (?:under |with )(?:the )?@gpl
1 @gpl licensed
1 @gpl licen[cs]e
lgpl-2
3 (?:the )?@gnu (?:library|lesser) general public licen[cs]e (?:version |v ?)?2(?: 0)?
3 @lgplv2
3 @lgpl (?:version |v ?)?2(?: 0)?
lgpl-2.1
4 gnu org licenses (?:old licenses )?@lgpl 2 1(?: html| txt)?
3 (?:the )?@gnu lesser general public licen[cs]e (?:version |v ?)?2 1
3 @lgplv2 1
3 @lgpl (?:version |v ?)?2 1
lgpl-3
4 gnu org licenses @lgpl 3 0(?: html| txt)?
3 (?:the )?@gnu lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
3 @lgplv3
3 @lgpl (?:version |v ?)?3(?: 0)?
lgpl
2 (?:the )?@gnu (?:lesser|library) general public licen[cs]e
2 (?:the )?(?:lesser|library) @gpl
1 (?:under |with )(?:the )?@lgpl
1 @lgpl licen[cs]e
agpl-3
4 gnu org licenses @agpl 3 0(?: html| txt)?
3 (?:the )?@gnu affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
3 @affero gpl (?:version |v ?)?3
3 @agplv3
3 @agpl (?:version |v ?)?3(?: 0)?
agpl
2 (?:the )?@gnu affero general public licen[cs]e
2 (?:the )?@affero (?:general public licen[cs]e|gpl)
1 @agpl licen[cs]e
1 (?:under |with )(?:the )?@agpl
gfdl-1.2
3 (?:the )?@gnu free documentation licen[cs]e (?:version |v ?)?1 2
gfdl-1.3
4 gnu org licenses @fdl 1 3(?: html| txt)?
3 (?:the )?@gnu free documentation licen[cs]e (?:version |v ?)?1 3
gfdl
2 (?:the )?@gnu free documentation licen[cs]e
1 (?:under |with )(?:the )?@gfdl
mpl-1.1
4 mozilla org mpl @mpl 1 1(?: html| txt)?
3 (?:the )?@mozilla public licen[cs]e (?:version |v ?)?1 1
3 @mpl (?:version |v ?)?1 1
mpl-2
4 mozilla org @mpl 2 0
4 mozilla org en us @mpl 2 0
3 (?:the )?@mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
3 @mpl (?:version |v ?)?2(?: 0)?
3 @mplv2
mpl
2 (?:the )?@mozilla public licen[cs]e
1 @mpl licen[cs]e
epl-1
4 eclipse org legal @epl v10(?: html)?
3 (?:the )?@eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl-2
4 eclipse org legal @epl 2 0
3 (?:the )?@eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl
2 (?:the )?@eclipse public licen[cs]e
cpl-1
3 (?:the )?common public @license version 1 0
cddl-1
3 @common development and distribution licen[cs]e (?:version )?1 0
3 @cddl (?:version |v ?)?1 0
cddl-1.1
3 @common development and distribution licen[cs]e (?:version )?1 1
3 @cddl (?:version |v ?)?1 1
cddl
2 @common development and distribution licen[cs]e
1 @cddl licen[cs]e
eupl-1.1
3 @european union public licen[cs]e (?:version |v ?)?1 1
3 @eupl (?:version |v ?)?1 1
eupl-1.2
3 @european union public licen[cs]e (?:version |v ?)?1 2
3 @eupl (?:version |v ?)?1 2
eupl
2 @european union public licen[cs]e
cecill-2.1
3 @cecill (?:licen[cs]e )?(?:version |v ?)?2 1
cecill
1 (?:licence |license )@cecill
1 @cecill licen[cs]e
artistic-1
3 (?:the )?@artistic licen[cs]e (?:version )?1 0
artistic-2
4 opensource org (?:license|licenses) @artistic 2 0
3 (?:the )?@artistic licen[cs]e (?:version )?2 0
artistic
2 (?:the )?@artistic licen[cs]e
afl-3
3 (?:the )?@academic free licen[cs]e (?:version |v ?)?3 0
osl-3
3 (?:the )?open software @license (?:version |v ?)?3 0
ecl-2
3 (?:the )?@educational community licen[cs]e (?:version )?2 0
unlicense
4 @unlicense org
3 (?:the )?@unlicense
2 this is free and @unencumbered software released into the public domain
public-domain
2 (?:released |placed |dedicated |put )?(?:in |into |to )?the public @domain
1 public @domain (?:work|dedication|mark)
wtfpl
3 (?:the )?@wtfpl
3 do what the fuck you want to public @license
beerware
3 (?:the )?beer @ware licen[cs]e
3 (?:the )?@beerware licen[cs]e
json
3 (?:the )?@json licen[cs]e
2 the software shall be used for @good not evil
openssl
3 (?:the )?@openssl licen[cs]e
php-3.01
3 (?:the )?@php licen[cs]e (?:version )?3 01
php
2 (?:the )?@php licen[cs]e
python-2
3 @python software foundation licen[cs]e(?: version 2)?
3 @psf licen[cs]e(?: agreement)?
postgresql
3 (?:the )?@postgresql licen[cs]e
ruby
2 (?:the )?@ruby licen[cs]e
vim
2 (?:the )?@vim licen[cs]e
w3c
3 @w3c software (?:and document )?(?:notice and )?licen[cs]e
unicode
3 @unicode (?:inc )?licen[cs]e(?: agreement)?
ms-pl
3 @microsoft public licen[cs]e
ms-rl
3 @microsoft reciprocal licen[cs]e
ncsa
3 university of @illinois (?:ncsa )?open source licen[cs]e
ofl-1.1
4 scripts sil org @ofl
3 @sil open font licen[cs]e(?: version)? 1 1
ofl
2 @sil open font licen[cs]e
2 open @font licen[cs]e
odbl-1
4 opendatacommons org licenses @odbl(?: 1 0)?
3 open database @license
3 open data commons open @database licen[cs]e
odc-by-1
4 opendatacommons org licenses @by(?: 1 0)?
3 open data commons @attribution licen[cs]e
pddl-1
4 opendatacommons org licenses @pddl(?: 1 0)?
3 public domain @dedication and licen[cs]e
cc0
4 creativecommons org publicdomain @zero 1 0
3 @cc0(?: 1 0)?(?: universal)?
3 creative commons @zero(?: licen[cs]e)?
cc-by
4 creativecommons org licenses @by [1-4] [05]
3 @cc by [1-4] [05]
3 creative commons @attribution (?:[1-4] [05] )?(?:international |unported |generic )?licen[cs]e
3 creative commons @attribution [1-4] [05]
2 @cc by
2 creative commons @attribution
cc-by-sa
4 creativecommons org licenses @by sa [1-4] [05]
3 @cc by sa(?: [1-4] [05])?
3 creative commons @attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd
4 creativecommons org licenses @by nd [1-4] [05]
3 @cc by nd(?: [1-4] [05])?
3 creative commons @attribution no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nc
4 creativecommons org licenses @by nc [1-4] [05]
3 @cc by nc(?: [1-4](?: [05])?)?
3 creative commons @attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa
4 creativecommons org licenses @by nc sa [1-4] [05]
3 @cc by nc sa(?: [1-4] [05])?
3 creative commons @attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd
4 creativecommons org licenses @by nc nd [1-4] [05]
3 @cc by nc nd(?: [1-4] [05])?
3 creative commons @attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?
creative-commons
1 (?:under |with )?(?:a |the )?creative @commons licen[cs]e
busl-1.1
3 business source @license(?: version)?(?: 1 1)?
sspl-1
3 server side public @license(?: version)?(?: 1)?
elastic-2
3 @elastic licen[cs]e (?:version |v ?)?2(?: 0)?
elastic
2 @elastic licen[cs]e
commons-clause
2 @commons clause licen[cs]e condition
upl-1
3 universal @permissive licen[cs]e(?: version| v)? 1 0
mulan-2
3 @mulan (?:psl|permissive software licen[cs]e)(?: version| v)? ?2
llama
3 @llama [234](?: [0-9])? community licen[cs]e(?: agreement)?
openrail
3 creative ml @openrail m
2 @openrail (?:m )?licen[cs]e
ogl
3 @open government licen[cs]e(?: v3 0| v2 0)?
proprietary
2 @proprietary and confidential
2 @unauthorized copying of this file via any medium is strictly prohibited
1 all rights @reserved
"""


def _rule(label: str, priority: int, text: str) -> Rule:
    keyword = re.search(r"@([a-z0-9]+)(?=$|[ (])", text)
    if text.count("@") != 1 or keyword is None:
        raise ValueError(f"a rule needs one marked keyword: {text!r}")
    return Rule(label, priority, keyword[1], f"(?:^| ){text}(?: |$)")


def rules() -> list[Rule]:
    """All rules in order."""
    out = []
    for entry in re.split(r";|\n", IDENTIFIERS.strip()):
        words, label = entry.rsplit(": ", 1)
        out.append(_rule(label.strip(), 4, f"(?:spdx )?license identifier @{words.strip()}"))
    label = ""
    for line in SIGNATURES.strip().split("\n"):
        if line[1:2] == " " and line[0].isdigit() and "@" in line:
            out.append(_rule(label, int(line[0]), line[2:]))
        else:
            label = line
    return out
