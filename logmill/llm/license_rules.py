"""The signature rules of the licence scan, written by hand.

A line is ``label; keyword; pattern; pattern; ...``. Patterns run over a text's words, lower-cased and joined by single
spaces, and match whole words. A rule runs only on texts that have its keyword as a word, so each pattern
of a line must contain the line's keyword. Rules higher up in TIERS stand above those further down; within a tier the
longer match stands above the shorter, and the order of lines decides between rules that match the same words.
"""

from __future__ import annotations

#: Contract phrases: their labels stay whatever else is found.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Whole notices and names with their version.
NOTICES = r"""
gpl-3.0; gnu; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3; gnu gpl (?:version |v ?)3; gnu gplv3(?: 0)?
gpl-3.0; gplv3; gplv3 or (?:any )?later
gpl-2.0; gnu; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2; gnu gpl (?:version |v ?)2; gnu gplv2(?: 0)?
gpl-2.0; gplv2; gplv2 or (?:any )?later
gpl-1.0; gnu; gnu general public license (?:version |v ?)1; gnu gpl (?:version |v ?)1
lgpl-3.0; gnu; gnu lesser general public license (?:version |v ?)3; gnu lgpl (?:version |v ?)3; gnu lgplv3
lgpl-2.1; gnu; gnu lesser general public license (?:version |v ?)2 1; gnu lgpl (?:version |v ?)2 1; gnu lgplv2 1
lgpl-2.0; gnu; gnu library general public license (?:version |v ?)2; gnu lgpl (?:version |v ?)2; gnu library general public license
agpl-3.0; gnu; gnu affero general public license (?:version |v ?)3; gnu agpl (?:version |v ?)3; gnu agplv3
agpl-1.0; affero; affero general public license (?:version |v ?)1
gfdl-1.3; gnu; gnu free documentation license (?:version |v ?)1 3
gfdl-1.2; gnu; gnu free documentation license (?:version |v ?)1 2
gfdl-1.1; gnu; gnu free documentation license (?:version |v ?)1 1
apache-2.0; apache; apache license version 2 0; licensed under the apache license; apache license 2 0; apache software license version 2 0; apache public license 2 0
apache-1.1; apache; apache software license version 1 1; apache license (?:version )?1 1
apache-1.0; apache; apache software license version 1 0; apache license (?:version )?1 0
mit; permission; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; mit; released under the mit license; licensed under the mit license; distributed under the (?:terms of the )?mit license; the mit license mit; under the terms of the mit license
x11; x11; x11 license; mit x11 license; licensed under the x11 license
bsd-3-clause; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; bsd; bsd 3 clause license; 3 clause bsd license; new bsd license; modified bsd license; revised bsd license
bsd-2-clause; bsd; bsd 2 clause license; 2 clause bsd license; simplified bsd license
bsd-2-clause; freebsd; freebsd license
bsd-4-clause; bsd; bsd 4 clause license; 4 clause bsd license; original bsd license; old bsd license
0bsd; bsd; zero clause bsd license; bsd zero clause license
0bsd; free; free public license 1 0 0
mpl-2.0; mozilla; mozilla public license (?:version |v )?2 0; subject to the terms of the mozilla public license v 2 0
mpl-1.1; mozilla; mozilla public license (?:version |v )?1 1
mpl-1.0; mozilla; mozilla public license (?:version |v )?1 0
epl-2.0; eclipse; eclipse public license (?:version |v )?2 0; eclipse public license 2
epl-1.0; eclipse; eclipse public license (?:version |v )?1 0; eclipse distribution license (?:version |v )?1 0
cpl-1.0; common; common public license (?:version |v )?1 0
ipl-1.0; ibm; ibm public license (?:version |v )?1 0
cddl-1.1; common; common development and distribution license (?:version )?1 1
cddl-1.0; common; common development and distribution license(?: version)?(?: 1 0)?
eupl-1.2; union; european union public licen[cs]e (?:version |v )?1 2
eupl-1.1; union; european union public licen[cs]e (?:version |v )?1 1
isc; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; isc; isc license
isc; consortium; internet systems consortium license
zlib; zlib; zlib license; zlib libpng license; licensed under the zlib license
zlib; provided; this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng; libpng; libpng license
libpng; png; png reference library license
bsl-1.0; boost; boost software license (?:version )?1 0; distributed under the boost software license
unlicense; unencumbered; this is free and unencumbered software released into the public domain
unlicense; unlicense; the unlicense; licensed under the unlicense
wtfpl; want; do what the fuck you want to public license; do what the f you want to public license
artistic-2.0; artistic; artistic license (?:version )?2 0
artistic-1.0; artistic; artistic license (?:version )?1 0; clarified artistic license; perl artistic license
python-2.0; python; python software foundation license(?: version 2)?; python license 2 0
python-2.0; psf; psf license agreement
ruby; ruby; same terms as ruby; ruby license; ruby s license
php-3.01; php; php license (?:version )?3 01
php-3.0; php; php license (?:version )?3 0
openssl; openssl; openssl license; openssl toolkit license; dual openssl and ssleay license
ofl-1.1; font; sil open font license(?: version)?(?: 1 1)?; open font license version 1 1
ncsa; ncsa; university of illinois ncsa open source license; ncsa open source license
ms-pl; microsoft; microsoft public license
ms-rl; microsoft; microsoft reciprocal license
osl-3.0; open; open software license (?:version |v )?3 0
osl-2.1; open; open software license (?:version |v )?2 1
afl-3.0; academic; academic free license (?:version |v )?3 0
afl-2.1; academic; academic free license (?:version |v )?2 1
ecl-2.0; educational; educational community license (?:version )?2 0
upl-1.0; universal; universal permissive license (?:version |v )?1 0
postgresql; postgresql; postgresql license; licensed under the postgresql licen[cs]e
unicode; unicode; unicode license agreement; unicode terms of use; unicode license v3
w3c; w3c; w3c software notice and license; w3c software and document license; w3c document license
cecill-2.1; cecill; cecill free software license agreement(?: version 2 1)?; licence cecill(?: version)? 2 1
cecill-b; cecill; cecill b free software license agreement; licence cecill b
cecill-c; cecill; cecill c free software license agreement; licence cecill c
apsl-2.0; apple; apple public source license(?: version)?(?: 2 0)?
intel; intel; intel open source license; intel simplified software license
sleepycat; sleepycat; sleepycat license; sleepycat public license
vim; vim; vim license; licensed under the vim license
qpl-1.0; q; q public license(?: version)?(?: 1 0)?
lppl-1.3c; latex; latex project public license(?: version)?(?: 1 3c?)?
ijg; jpeg; independent jpeg group license; independent jpeg group s software
curl; curl; curl license; mit like curl license
tcl; tcl; tcl tk license; tcl license terms
json; shall; the software shall be used for good not evil
odbl-1.0; open; open database licen[cs]e(?: odbl)?(?: v| version)?(?: 1 0)?
odbl-1.0; odbl; odbl v1 0
odc-by-1.0; open; open data commons attribution licen[cs]e(?: v| version)?(?: 1 0)?
pddl-1.0; open; open data commons public domain dedication and licen[cs]e
elastic-2.0; elastic; elastic license (?:version |v )?2 0; elastic license v2
sspl-1.0; server; server side public license(?: version)?(?: 1)?
sspl-1.0; sspl; sspl v1
busl-1.1; business; business source license(?: version)?(?: 1 1)?
polyform; polyform; polyform noncommercial license(?: 1 0 0)?; polyform shield license(?: 1 0 0)?; polyform small business license(?: 1 0 0)?
commons-clause; clause; commons clause license condition(?: v1 0)?; commons clause restriction
llama; llama; llama \d+(?: \d+)? community license agreement; llama community license
openrail; creativeml; creativeml open rail m license
openrail; openrail; bigscience openrail m license; openrail m license; openrail license
gemma; gemma; gemma terms of use; gemma license
cc-by-nc-nd; creative; creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?(?: \d 0)?(?: international)?
cc-by-nc-sa; creative; creative commons attribution non ?commercial share ?alike(?: \d 0)?(?: international)?
cc-by-nc; creative; creative commons attribution non ?commercial(?: \d 0)?(?: international)?
cc-by-nd; creative; creative commons attribution no ?deriv(?:ative|atives|s)(?: works)?(?: \d 0)?(?: international)?
cc-by-sa; creative; creative commons attribution share ?alike(?: \d 0)?(?: international)?; creative commons share ?alike
cc-by; creative; creative commons attribution(?: \d 0)?(?: international)?(?: license)?
cc0-1.0; creative; creative commons zero(?: v1 0)?(?: universal)?; creative commons public domain dedication
cc0-1.0; cc0; cc0 1 0 universal; cc0 public domain dedication
"""

#: Short names as in tags, addresses and badges.
TAGS = r"""
gpl-3.0; gpl; spdx license identifier gpl 3 0(?: only| or later)?; gpl 3 0(?: only| or later)?; gnu org licenses gpl 3 0; gpl v3
gpl-2.0; gpl; spdx license identifier gpl 2 0(?: only| or later)?; gpl 2 0(?: only| or later)?; gnu org licenses gpl 2 0; gpl v2
lgpl-3.0; lgpl; spdx license identifier lgpl 3 0(?: only| or later)?; lgpl 3 0(?: only| or later)?; gnu org licenses lgpl 3 0; lgpl v3
lgpl-2.1; lgpl; spdx license identifier lgpl 2 1(?: only| or later)?; lgpl 2 1(?: only| or later)?; gnu org licenses lgpl 2 1; lgpl v2 1
agpl-3.0; agpl; spdx license identifier agpl 3 0(?: only| or later)?; agpl 3 0(?: only| or later)?; gnu org licenses agpl 3 0; agpl v3
gfdl; fdl; gnu org licenses fdl(?: 1 \d)?; gnu fdl
gfdl; gfdl; spdx license identifier gfdl
apache-2.0; apache; spdx license identifier apache 2 0; apache org licenses license 2 0; apache 2 0; apache v2 0
mit; mit; spdx license identifier mit; opensource org licenses mit(?: license)?; license mit; mit licensed
bsd-3-clause; bsd; spdx license identifier bsd 3 clause; opensource org licenses bsd 3 clause; bsd 3 clause; license bsd
bsd-2-clause; bsd; spdx license identifier bsd 2 clause; opensource org licenses bsd 2 clause; bsd 2 clause
mpl-2.0; mpl; spdx license identifier mpl 2 0; mozilla org mpl 2 0; mozilla org en us mpl 2 0; mpl 2 0
mpl-2.0; mplv2; mplv2
epl-2.0; epl; spdx license identifier epl 2 0; eclipse org legal epl 2 0; epl 2 0
epl-1.0; epl; spdx license identifier epl 1 0; eclipse org legal epl v10; epl 1 0
isc; isc; spdx license identifier isc; opensource org licenses isc; license isc
zlib; zlib; spdx license identifier zlib; opensource org licenses zlib
bsl-1.0; bsl; spdx license identifier bsl 1 0
bsl-1.0; boost; boost org license 1 0 txt
unlicense; unlicense; spdx license identifier unlicense; unlicense org
ofl-1.1; ofl; spdx license identifier ofl 1 1; scripts sil org ofl; ofl 1 1
cc0-1.0; cc0; spdx license identifier cc0 1 0; cc0 1 0; cc0
cc0-1.0; publicdomain; creativecommons org publicdomain zero 1 0
cc-by-nc-nd; cc; spdx license identifier cc by nc nd \d 0; cc by nc nd(?: \d 0)?
cc-by-nc-sa; cc; spdx license identifier cc by nc sa \d 0; cc by nc sa(?: \d 0)?
cc-by-nc; cc; spdx license identifier cc by nc \d 0; cc by nc(?: \d 0)?
cc-by-nd; cc; spdx license identifier cc by nd \d 0; cc by nd(?: \d 0)?
cc-by-sa; cc; spdx license identifier cc by sa \d 0; cc by sa(?: \d 0)?
cc-by-4.0; cc; spdx license identifier cc by 4 0; cc by 4 0
cc-by-3.0; cc; spdx license identifier cc by 3 0; cc by 3 0
cc-by-2.0; cc; spdx license identifier cc by 2 0; cc by 2 0; cc by 2 5
cc-by-nc-nd; creativecommons; creativecommons org licenses by nc nd
cc-by-nc-sa; creativecommons; creativecommons org licenses by nc sa
cc-by-nc; creativecommons; creativecommons org licenses by nc
cc-by-nd; creativecommons; creativecommons org licenses by nd
cc-by-sa; creativecommons; creativecommons org licenses by sa
cc-by; creativecommons; creativecommons org licenses by
"""

#: Names without a version, and general statements.
NAMES = r"""
lgpl; lesser; gnu lesser general public license; lesser general public license; lesser gpl
agpl; affero; gnu affero general public license; affero general public license; affero gpl
gfdl; documentation; gnu free documentation license; free documentation license
gpl; gpl; gnu gpl; under the gpl; gpl license; gpl licensed; gpl compatible
lgpl; lgpl; gnu lgpl; under the lgpl; lgpl license
agpl; agpl; gnu agpl; under the agpl; agpl license
apache; apache; apache software license; apache licensed; apache style license
bsd; bsd; bsd license; bsd style license; bsd licensed
bsd; berkeley; berkeley software distribution license
mit; mit; mit style license; mit licen[cs]e
mit; massachusetts; massachusetts institute of technology license
mpl; mozilla; mozilla public license
epl; eclipse; eclipse public license
artistic; artistic; artistic license
eupl; union; european union public licen[cs]e
cddl; cddl; cddl license; under the cddl
php; php; php license
cc; creative; creative commons license; creative commons
cc; cc; cc license
public-domain; domain; released into the public domain; placed in the public domain; in the public domain; dedicated to the public domain; public domain
proprietary; reserved; all rights reserved
proprietary; confidential; proprietary and confidential; confidential and proprietary; company confidential
proprietary; proprietary; proprietary license; proprietary software license
proprietary; unauthorized; unauthorized copying of this file
commercial; commercial; commercial license; for commercial use contact; non commercial use only; no commercial use; personal and non commercial use
shareware; shareware; shareware license; this is shareware
freeware; freeware; freeware license; this is freeware
eula; user; end user license agreement; end user licence agreement
"""

#: (name, text, confidence), from the strongest down.
TIERS = [("notice", NOTICES, 0.95), ("tag", TAGS, 0.85), ("name", NAMES, 0.6)]
