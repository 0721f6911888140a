"""Signatures of licenses, in order: label, keyword, priority and a regex over words.

A line of RULES is `label | keyword | priority | regex`. A blank in a regex stands between two words; words are lower-cased runs of
digits, ASCII letters and characters beyond ASCII, so that "Apache-2.0" is "apache 2 0". A match is of whole words. Every match holds
the keyword as a word. Priorities: 4 wording that only the license itself has, 3 a name with its version or address, 2 a name, 1 a
statement that names no license. Of two that match the same words with one priority the first line wins.
"""

from __future__ import annotations

from typing import NamedTuple

RULES = r"""
apache-2.0 | apache | 3 | apache(?: software)? license(?: version)?(?: v)? 2(?: 0)?
apache-2.0 | apache | 3 | apache(?: software)? license(?: version)? v2(?: 0)?
apache-2.0 | apache | 3 | apache 2(?: 0)?(?: license| licence)?
apache-2.0 | apache | 3 | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | apache | 3 | spdx license identifier apache 2 0
apache-2.0 | apache2 | 3 | apache2(?: 0)? (?:license|licence|licensed)
apache-2.0 | conditions | 4 | terms and conditions for use reproduction and distribution
apache-2.0 | perpetual | 4 | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2.0 | warranties | 4 | on an as is basis without warranties or conditions of any kind
apache-1.1 | apache | 3 | apache(?: software)? license(?: version)? 1 1
apache-1.0 | apache | 3 | apache(?: software)? license(?: version)? 1 0
apache | apache | 2 | apache(?: software)? (?:license|licence)
mit | mit | 3 | mit (?:license|licence)
mit | mit | 3 | mit (?:style|type) (?:license|licence)
mit | mit | 3 | opensource org licenses mit(?: license)?(?: php| html)?
mit | mit | 3 | spdx license identifier mit
mit | mit | 2 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? mit
mit | permission | 4 | permission is hereby granted free of charge to any person obtaining a copy
mit | permission | 4 | the above copyright notice and this permission notice shall be included in all copies
mit-0 | mit | 3 | mit 0(?: license)?
mit-0 | mit | 3 | mit no attribution
expat | expat | 2 | expat (?:license|licence)
x11 | x11 | 2 | x11 (?:license|licence)
isc | isc | 3 | isc (?:license|licence)
isc | isc | 3 | opensource org licenses isc(?: license)?
isc | isc | 3 | spdx license identifier isc
isc | permission | 4 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 0bsd | 3 | 0bsd
0bsd | bsd | 3 | bsd zero clause(?: license)?
0bsd | bsd | 3 | zero clause bsd(?: license)?
bsd-2-clause | bsd | 3 | bsd 2 clause(?: license)?
bsd-2-clause | bsd | 3 | (?:simplified|freebsd) bsd(?: license)?
bsd-2-clause | bsd | 3 | (?:two|2) clause bsd(?: license)?
bsd-2-clause | bsd | 3 | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | 3 | bsd 3 clause(?: license)?
bsd-3-clause | bsd | 3 | (?:new|modified|revised) bsd(?: license)?
bsd-3-clause | bsd | 3 | (?:three|3) clause bsd(?: license)?
bsd-3-clause | bsd | 3 | opensource org licenses bsd 3 clause
bsd-3-clause | endorse | 4 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | bsd | 3 | bsd 4 clause(?: license)?
bsd-4-clause | bsd | 3 | (?:original|four clause|4 clause) bsd(?: license)?
bsd-4-clause | advertising | 4 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | bsd | 2 | bsd (?:license|licence|licensed)
bsd | bsd | 2 | bsd (?:style|type) (?:license|licence)
bsd | bsd | 2 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? bsd
bsd | redistribution | 4 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 4 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 4 | redistributions in binary form must reproduce the above copyright notice
gpl-1.0 | gpl | 3 | gpl(?: v| version)? 1(?: 0)?(?: only| or later)?
gpl-1.0 | general | 3 | general public license(?: version)? 1(?: 0)?
gpl-2.0 | gplv2 | 3 | gplv2(?: only| or later)?
gpl-2.0 | gpl | 3 | gpl(?: v| version)? 2(?: 0)?(?: only)?
gpl-2.0 | gpl | 3 | gpl v2(?: 0)?(?: only)?
gpl-2.0 | gpl2 | 3 | (?:gnu )?gpl2
gpl-2.0 | general | 3 | general public license(?: version| v)? 2(?: 0)?
gpl-2.0 | general | 3 | general public license v2(?: 0)?
gpl-2.0 | gnu | 3 | gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?
gpl-2.0 | gpl | 3 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | gpl | 3 | gpl(?: v| version)? 2(?: 0)? or(?: any)? later(?: version)?
gpl-2.0-or-later | general | 3 | general public license(?: as published by the free software foundation)? either version 2(?: of the license)? or at your option any later version
gpl-3.0 | gplv3 | 3 | gplv3(?: only| or later)?
gpl-3.0 | gpl | 3 | gpl(?: v| version)? 3(?: 0)?(?: only)?
gpl-3.0 | gpl | 3 | gpl v3(?: 0)?(?: only)?
gpl-3.0 | gpl3 | 3 | (?:gnu )?gpl3
gpl-3.0 | general | 3 | general public license(?: version| v)? 3(?: 0)?
gpl-3.0 | general | 3 | general public license v3(?: 0)?
gpl-3.0 | gnu | 3 | gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0 | gpl | 3 | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | gpl | 3 | gpl(?: v| version)? 3(?: 0)? or(?: any)? later(?: version)?
gpl-3.0-or-later | general | 3 | general public license(?: as published by the free software foundation)? either version 3(?: of the license)? or at your option any later version
gnu-gpl | gpl | 2 | gnu gpl
gnu-gpl | gpl | 2 | gpl (?:license|licence|licensed)
gnu-gpl | gnu | 2 | gnu general public (?:license|licence)
gnu-gpl | gnu | 2 | gnu org licenses gpl(?: html| txt)?
gnu-gpl | gpl | 2 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? gpl
gnu-gpl | copyleft | 4 | everyone is permitted to copy and distribute verbatim copies of this license document(?: but changing it is not allowed)? copyleft
gnu-gpl | verbatim | 4 | everyone is permitted to copy and distribute verbatim copies of this license document
gnu-gpl | hope | 4 | is distributed in the hope that it will be useful but without any warranty
lgpl-2.0 | library | 3 | (?:gnu )?library general public license(?: version)? 2(?: 0)?
lgpl-2.0 | lgpl | 3 | lgpl(?: v| version)? 2 0(?: only| or later)?
lgpl-2.1 | lgplv2 | 3 | lgplv2(?: 1)?(?: only| or later)?
lgpl-2.1 | lgpl | 3 | lgpl(?: v| version)? 2 1(?: only| or later)?
lgpl-2.1 | lesser | 3 | (?:gnu )?lesser general public license(?: version| v)? 2 1
lgpl-2.1 | gnu | 3 | gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?
lgpl-3.0 | lgplv3 | 3 | lgplv3(?: only| or later)?
lgpl-3.0 | lgpl | 3 | lgpl(?: v| version)? 3(?: 0)?(?: only| or later)?
lgpl-3.0 | lesser | 3 | (?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?
lgpl-3.0 | gnu | 3 | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl | lgpl | 2 | (?:gnu )?lgpl
lgpl | lesser | 2 | (?:gnu )?lesser general public (?:license|licence)
lgpl | library | 2 | (?:gnu )?library general public (?:license|licence)
agpl-3.0 | agplv3 | 3 | agplv3(?: only| or later)?
agpl-3.0 | agpl | 3 | agpl(?: v| version)? 3(?: 0)?(?: only| or later)?
agpl-3.0 | affero | 3 | (?:gnu )?affero general public license(?: version| v)? 3(?: 0)?
agpl-3.0 | gnu | 3 | gnu org licenses agpl 3 0(?: html| txt)?
agpl | agpl | 2 | (?:gnu )?agpl
agpl | affero | 2 | (?:gnu )?affero general public (?:license|licence)
gfdl-1.1 | documentation | 3 | (?:gnu )?free documentation license(?: version)? 1 1
gfdl-1.2 | documentation | 3 | (?:gnu )?free documentation license(?: version)? 1 2
gfdl-1.3 | documentation | 3 | (?:gnu )?free documentation license(?: version)? 1 3
gfdl | documentation | 2 | (?:gnu )?free documentation (?:license|licence)
gfdl | gfdl | 2 | (?:gnu )?gfdl(?: 1 [123])?
gfdl | invariant | 4 | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | mozilla | 3 | mozilla public license(?: version)? 1 0
mpl-1.1 | mozilla | 3 | mozilla public license(?: version)? 1 1
mpl-1.1 | mpl | 3 | mpl(?: v| version)? 1 1
mpl-2.0 | mozilla | 3 | mozilla public license(?: version| v)? 2(?: 0)?
mpl-2.0 | mozilla | 3 | mozilla org mpl 2 0
mpl-2.0 | mozilla | 4 | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | mpl | 3 | mpl(?: v| version)? 2(?: 0)?
mpl | mozilla | 2 | mozilla public (?:license|licence)
epl-1.0 | eclipse | 3 | eclipse public license(?: version| v)? 1(?: 0)?
epl-1.0 | epl | 3 | epl(?: v| version)? 1 0
epl-2.0 | eclipse | 3 | eclipse public license(?: version| v)? 2(?: 0)?
epl-2.0 | epl | 3 | epl(?: v| version)? 2 0
epl | eclipse | 2 | eclipse public (?:license|licence)
edl-1.0 | eclipse | 3 | eclipse distribution license(?: version| v)?(?: 1 0)?
cddl-1.0 | cddl | 3 | cddl(?: v| version)? 1 0
cddl-1.1 | cddl | 3 | cddl(?: v| version)? 1 1
cddl | cddl | 2 | cddl (?:license|licence)
cddl | development | 2 | common development and distribution license
cpl-1.0 | common | 3 | common public license(?: version| v)?(?: 1 0)?
ipl-1.0 | ibm | 3 | ibm public license(?: version| v)?(?: 1 0)?
eupl-1.1 | eupl | 3 | eupl(?: v| version)? 1 1
eupl-1.2 | eupl | 3 | eupl(?: v| version)? 1 2
eupl | union | 2 | european union public (?:license|licence)
cecill | cecill | 2 | cecill(?: [bc])?(?: license| licence)?(?: 2 [01])?
artistic-1.0 | artistic | 3 | artistic license(?: version)? 1(?: 0)?
artistic-2.0 | artistic | 3 | artistic license(?: version)? 2(?: 0)?
artistic | artistic | 2 | (?:perl )?artistic (?:license|licence)
perl | perl | 2 | same terms as perl(?: itself)?
python-2.0 | python | 3 | python software foundation license(?: version)? 2
psf | python | 2 | python software foundation (?:license|licence)
psf | psf | 2 | psf (?:license|licence)
php-3.01 | php | 3 | php license(?: version)? 3 01
php | php | 2 | php (?:license|licence)
ruby | ruby | 2 | ruby (?:license|licence)
zlib | zlib | 3 | zlib(?: libpng)? (?:license|licence)
zlib | misrepresented | 4 | the origin of this software must not be misrepresented
libpng | libpng | 2 | libpng (?:license|licence)
openssl | openssl | 2 | openssl (?:license|licence)
openssl | openssl | 4 | this product includes software developed by the openssl project
boost-1.0 | boost | 3 | boost software license(?: version)?(?: 1 0)?
boost-1.0 | bsl | 3 | bsl 1 0
boost-1.0 | boost | 3 | boost org license 1 0 txt
bsl-1.1 | business | 3 | business source license(?: version)?(?: 1 1)?
bsl-1.1 | busl | 3 | busl 1 1
sspl-1.0 | sspl | 3 | sspl(?: v1| 1 0)?
sspl-1.0 | server | 3 | server side public license(?: version)?(?: 1)?
elastic-2.0 | elastic | 3 | elastic license(?: version| v2)?(?: 2 0)?
commons-clause | commons | 3 | commons clause(?: license)?(?: condition v1 0)?
polyform | polyform | 3 | polyform (?:noncommercial|small business|shield|perimeter|strict|free trial)(?: license)?(?: 1 0 0)?
unlicense | unlicense | 3 | the unlicense
unlicense | unlicense | 3 | unlicense org
unlicense | unencumbered | 4 | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | 3 | wtfpl(?: license)?(?: version 2)?
wtfpl | fuck | 4 | do what the fuck you want to(?: public license)?
beerware | beerware | 2 | beerware(?: license)?
beerware | beer | 2 | beer ware license(?: revision 42)?
json | evil | 4 | the software shall be used for good not evil
postgresql | postgresql | 3 | postgresql (?:license|licence)
curl | curl | 2 | curl (?:license|licence)
ncsa | ncsa | 3 | university of illinois ncsa open source license
ncsa | ncsa | 2 | ncsa (?:license|licence)
w3c | w3c | 3 | w3c (?:software|document)(?: notice and)?(?: license| licence)
afl-3.0 | academic | 3 | academic free license(?: version| v)?(?: 3 0)?
osl-3.0 | osl | 3 | osl(?: v| version)? 3 0
osl-3.0 | open | 3 | open software license(?: version| v)? 3 0
ecl-2.0 | educational | 3 | educational community license(?: version)?(?: 2 0)?
ms-pl | microsoft | 3 | microsoft public license(?: ms pl)?
ms-rl | microsoft | 3 | microsoft reciprocal license(?: ms rl)?
upl-1.0 | universal | 3 | universal permissive license(?: version| v)?(?: 1 0)?
ofl-1.1 | sil | 3 | sil open font license(?: version)?(?: 1 1)?
ofl-1.1 | ofl | 3 | ofl(?: v| version)? 1 1
ofl | font | 2 | open font (?:license|licence)
vim | vim | 2 | vim (?:license|licence)
tex | latex | 3 | latex project public license(?: version)?(?: 1 3c?)?
tex | lppl | 3 | lppl(?: version)?(?: 1 3c?)?
qpl-1.0 | qpl | 3 | qpl 1 0
sleepycat | sleepycat | 2 | sleepycat (?:license|licence)
zpl-2.1 | zope | 3 | zope public license(?: version| v)?(?: 2 [01])?
blueoak-1.0.0 | blue | 3 | blue oak model license(?: 1 0 0)?
mulan-2.0 | mulan | 3 | mulan(?: permissive software license| psl)(?: v2| version 2)?
hippocratic | hippocratic | 3 | hippocratic license(?: version)?(?: [123] [01])?
rail | responsible | 3 | (?:bigscience |creativeml )?responsible ai license
rail | openrail | 3 | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
llama | llama | 3 | llama(?: [234])?(?: [0-9])? community license(?: agreement)?
gemma | gemma | 3 | gemma terms of use
cc0-1.0 | cc0 | 3 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creativecommons | 3 | creativecommons org publicdomain zero 1 0
cc0-1.0 | commons | 3 | creative commons zero(?: 1 0| v1 0)?(?: universal)?
cc-pdm-1.0 | creativecommons | 3 | creativecommons org publicdomain mark 1 0
cc-by-1.0 | cc | 3 | cc by 1 0
cc-by-2.0 | cc | 3 | cc by 2 0
cc-by-2.5 | cc | 3 | cc by 2 5
cc-by-3.0 | cc | 3 | cc by 3 0(?: unported| igo)?
cc-by-4.0 | cc | 3 | cc by 4 0(?: international)?
cc-by-4.0 | creativecommons | 3 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | 3 | creativecommons org licenses by 3 0
cc-by-2.0 | creativecommons | 3 | creativecommons org licenses by 2 0
cc-by-4.0 | commons | 3 | creative commons attribution 4 0(?: international)?(?: license| licence)?
cc-by-3.0 | commons | 3 | creative commons attribution 3 0(?: unported)?(?: license| licence)?
cc-by-sa-2.5 | cc | 3 | cc by sa 2 5
cc-by-sa-3.0 | cc | 3 | cc by sa 3 0(?: unported)?
cc-by-sa-4.0 | cc | 3 | cc by sa 4 0(?: international)?
cc-by-sa-3.0 | creativecommons | 3 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons | 3 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | commons | 3 | creative commons attribution share ?alike 3 0(?: unported)?(?: license| licence)?
cc-by-sa-4.0 | commons | 3 | creative commons attribution share ?alike 4 0(?: international)?(?: license| licence)?
cc-by-nd-3.0 | cc | 3 | cc by nd 3 0
cc-by-nd-4.0 | cc | 3 | cc by nd 4 0(?: international)?
cc-by-nd-4.0 | creativecommons | 3 | creativecommons org licenses by nd 4 0
cc-by-nd-4.0 | commons | 3 | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license| licence)?
cc-by-nc-2.0 | cc | 3 | cc by nc 2 0
cc-by-nc-3.0 | cc | 3 | cc by nc 3 0(?: unported)?
cc-by-nc-4.0 | cc | 3 | cc by nc 4 0(?: international)?
cc-by-nc-3.0 | creativecommons | 3 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | creativecommons | 3 | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | commons | 3 | creative commons attribution non ?commercial 4 0(?: international)?(?: license| licence)?
cc-by-nc-sa-3.0 | cc | 3 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | 3 | cc by nc sa 4 0(?: international)?
cc-by-nc-sa-4.0 | creativecommons | 3 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | commons | 3 | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license| licence)?
cc-by-nc-nd-3.0 | cc | 3 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | 3 | cc by nc nd 4 0(?: international)?
cc-by-nc-nd-4.0 | creativecommons | 3 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | commons | 3 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license| licence)?
cc-by-sa | cc | 2 | cc by sa
cc-by-nd | cc | 2 | cc by nd
cc-by-nc | cc | 2 | cc by nc
cc-by-nc-sa | cc | 2 | cc by nc sa
cc-by-nc-nd | cc | 2 | cc by nc nd
cc-sampling | commons | 2 | creative commons sampling(?: plus)?(?: 1 0)?
creative-commons | commons | 2 | creative commons(?: attribution)?(?: license| licence)?
creative-commons | creativecommons | 2 | creativecommons org licenses
odbl-1.0 | odbl | 3 | odbl(?: v1| 1 0)?
odbl-1.0 | database | 3 | open (?:data commons open )?database license(?: v1)?(?: 1 0)?
odc-by-1.0 | odc | 3 | odc by(?: v1| 1 0)?
odc-by-1.0 | commons | 3 | open data commons attribution license(?: v1)?(?: 0)?
pddl-1.0 | pddl | 3 | pddl(?: v1| 1 0)?
ogl-uk-3.0 | government | 3 | open government licence(?: version| v)? ?3(?: 0)?
ogl-uk | government | 2 | open government (?:license|licence)
cdla-permissive | cdla | 3 | cdla permissive(?: [12] 0)?
cdla-sharing | cdla | 3 | cdla sharing(?: 1 0)?
etalab | etalab | 3 | etalab open licence(?: 2 0)?
etalab | etalab | 3 | licence ouverte etalab(?: 2 0)?
dl-de-by-2.0 | datenlizenz | 3 | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
dl-de-zero-2.0 | datenlizenz | 3 | datenlizenz deutschland zero(?: version)?(?: 2 0)?
public-domain | domain | 2 | (?:released|placed|dedicated)(?: in)? to the public domain
public-domain | domain | 2 | (?:is|are) in the public domain
public-domain | domain | 1 | public domain
proprietary | proprietary | 2 | proprietary and confidential
proprietary | unauthorized | 4 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | reproduced | 4 | no part of this (?:publication|book|work) may be reproduced(?: stored| distributed| or transmitted)*
proprietary | redistributed | 2 | may not be (?:published broadcast rewritten or )?redistributed
eula | eula | 2 | (?:end user license agreement )?eula
eula | agreement | 2 | end user licen[cs]e agreement
freeware | freeware | 2 | (?:licensed|released|distributed) as freeware
shareware | shareware | 2 | (?:licensed|released|distributed) as shareware
non-commercial | commercial | 1 | for non commercial (?:use|purposes)(?: only)?
non-commercial | noncommercial | 1 | for noncommercial (?:use|purposes)(?: only)?
research-only | research | 1 | for research (?:use|purposes) only
personal-use | personal | 1 | for personal use only
no-warranty | warranty | 4 | the software is provided as is without warranty of any kind
no-warranty | warranty | 1 | without(?: any)? warranty of any kind
no-warranty | liable | 4 | in no event shall the authors or copyright holders be liable
copyright | copyright | 1 | copyright(?: c)?(?: ©)? [12][0-9]{3}(?: [12][0-9]{3})*
copyright | © | 1 | © [12][0-9]{3}(?: [12][0-9]{3})*
copyright | copyrighted | 1 | copyrighted (?:material|work|by)
spdx | spdx | 1 | spdx license identifier [a-z0-9]+
licensed | licensed | 1 | (?:dual )?licensed under(?: the)?(?: terms of the)? [a-z0-9]+
licensed | license | 1 | (?:released|distributed|available|published) under(?: the)?(?: terms of the)?(?: [a-z0-9]+){1,3} license
licensed | licence | 1 | (?:released|distributed|available|published) under(?: the)?(?: terms of the)?(?: [a-z0-9]+){1,3} licence
licensed | license | 1 | see(?: the)? license(?: file| md| txt)? for(?: more)?(?: details| information)
dual | dual | 1 | dual licen[cs]e(?:d)?
trademark | trademark | 1 | (?:registered )?trademark of
trademark | trademarks | 1 | (?:registered )?trademarks of
patent | patent | 1 | patent pending
patent | patents | 1 | patents pending
"""

#: Phrases whose labels always stand, whatever else matches.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: How surely a label of each priority means that the text is under a license; the last is that of BASE.
WEIGHTS = {1: 0.3, 2: 0.6, 3: 0.9, 4: 0.95, "base": 0.5}


class Rule(NamedTuple):
    id: int
    label: str
    keyword: str
    priority: int
    pattern: str


def widened(regex: str) -> str:
    """The regex over words that each have a blank on both sides."""
    return f" {regex.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')} "


def rules(text: str = RULES) -> list[Rule]:
    lines = [[x.strip() for x in line.split(" | ", 3)] for line in text.strip().splitlines()]
    return [Rule(k, label, keyword, int(priority), widened(regex)) for k, (label, keyword, priority, regex) in enumerate(lines)]
