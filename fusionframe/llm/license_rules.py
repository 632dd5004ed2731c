"""Signature rules of the license scan, written by hand, in order of preference.

Each line is: label, gate, priority, pattern. The gate is a beginning of a word that every match holds; a
rule is tried only on texts that hold its gate. Priority 3 is an exact notice or identifier, 2 a name
with what tells its version or form, 1 a mention. A pattern is a list of words, each a regular
expression of its own; `~word` may be missing, and `*n` stands for up to n words of any kind.
"""

from __future__ import annotations

#: The contract's phrases.
BASE = """
mit licen 3 under the mit license
apache-2 licen 3 apache license version 2
cc-by-nc cc 3 cc by nc
"""

SIGNATURES = """
mit spdx 3 spdx licen[cs]e identifier mit
mit licen 3 (released|distributed|licen[cs]ed|published|available) under ~the ~terms ~of ~the mit ~x11 licen[cs]e
mit licen 2 mit licen[cs]e
mit licen 2 mit style licen[cs]e
mit licen 2 licen[cs]e mit
mit opensource 3 opensource org licenses mit ~license ~php
mit permission 3 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit permission 2 the above copyright notice and this permission notice ~(including) *6 shall be included in all copies
mit expat 2 expat licen[cs]e
x11 x11 2 x11 licen[cs]e
x11 spdx 3 spdx licen[cs]e identifier x11
mit-0 spdx 3 spdx licen[cs]e identifier mit 0
mit-0 attribution 2 mit no attribution
apache-2 spdx 3 spdx licen[cs]e identifier apache 2 ~0
apache-2 apache 3 licen[cs]ed under ~the ~terms ~of ~the apache ~software licen[cs]e ~version 2 ~0
apache-2 apache 3 apache org licenses license 2 0
apache-2 apache 2 apache ~software ~foundation licen[cs]e ~version v?2 ~0
apache-2 apache 2 apache ~licen[cs]e 2 0
apache-2 apache 2 apache2 ~0 ~licen[cs]e
apache-2 apache 2 licen[cs]e apache 2 ~0
apache-1.1 spdx 3 spdx licen[cs]e identifier apache 1 1
apache-1.1 apache 2 apache ~software licen[cs]e ~version 1 1
apache-1.0 apache 2 apache ~software licen[cs]e ~version 1 0
apache apache 1 apache ~software licen[cs]e
gpl-3 spdx 3 spdx licen[cs]e identifier gpl 3 0 ~(only|or) ~later
gpl-3 gnu 3 gnu general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either ~version v?3
gpl-3 gnu 3 licen[cs]ed under ~the ~terms ~of ~the gnu general public licen[cs]e ~version v?3
gpl-3 gnu 3 gnu org licenses gpl 3 0
gpl-3 gpl 2 gpl v?3 ~0
gpl-3 gpl 2 gplv3
gpl-3 gpl 2 gpl version 3
gpl-3 general 2 general public licen[cs]e v?3
gpl-3 gnu 2 version 3 of the gnu general public licen[cs]e
gpl-2 spdx 3 spdx licen[cs]e identifier gpl 2 0 ~(only|or) ~later
gpl-2 gnu 3 gnu general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either ~version v?2
gpl-2 gnu 3 licen[cs]ed under ~the ~terms ~of ~the gnu general public licen[cs]e ~version v?2
gpl-2 gnu 3 gnu org licenses ~old ~licenses gpl 2 0
gpl-2 gpl 2 gpl v?2 ~0
gpl-2 gpl 2 gplv2
gpl-2 gpl 2 gpl version 2
gpl-2 general 2 general public licen[cs]e v?2
gpl-2 gnu 2 version 2 of the gnu general public licen[cs]e
gpl-1 spdx 3 spdx licen[cs]e identifier gpl 1 0 ~(only|or) ~later
gpl-1 gnu 2 gnu general public licen[cs]e ~version 1
gpl gnu 1 gnu general public licen[cs]e
gpl gnu 1 gnu gpl
gpl gpl 1 gpl licen[cs]ed?
gpl gpl 1 (under|the) gpl
gpl allgemeine 1 gnu allgemeine öffentliche lizenz
lgpl-3 spdx 3 spdx licen[cs]e identifier lgpl 3 0 ~(only|or) ~later
lgpl-3 gnu 3 gnu lesser general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either ~version v?3
lgpl-3 gnu 3 gnu org licenses lgpl 3 0
lgpl-3 lgpl 2 lgpl v?3 ~0
lgpl-3 lgpl 2 lgplv3
lgpl-3 lesser 2 lesser general public licen[cs]e v?3
lgpl-2.1 spdx 3 spdx licen[cs]e identifier lgpl 2 1 ~(only|or) ~later
lgpl-2.1 gnu 3 gnu lesser general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either ~version v?2 1
lgpl-2.1 gnu 3 gnu org licenses ~old ~licenses lgpl 2 1
lgpl-2.1 lgpl 2 lgpl v?2 1
lgpl-2.1 lgpl 2 lgplv2 1
lgpl-2.1 lesser 2 lesser general public licen[cs]e v?2 1
lgpl-2 spdx 3 spdx licen[cs]e identifier lgpl 2 0 ~(only|or) ~later
lgpl-2 library 2 gnu library general public licen[cs]e ~version ~v?2 ~0
lgpl-2 lgpl 2 lgpl v?2 0
lgpl lesser 1 ~gnu lesser general public licen[cs]e
lgpl lgpl 1 (gnu|the|under) lgpl
agpl-3 spdx 3 spdx licen[cs]e identifier agpl 3 0 ~(only|or) ~later
agpl-3 affero 3 gnu affero general public licen[cs]e ~as ~published ~by ~the ~free ~software ~foundation ~either ~version v?3
agpl-3 gnu 3 gnu org licenses agpl 3 0
agpl-3 agpl 2 agpl v?3 ~0
agpl-3 agpl 2 agplv3
agpl affero 1 ~gnu affero general public licen[cs]e
agpl agpl 1 (gnu|the|under) agpl
agpl-1 affero 2 affero general public licen[cs]e version 1
gfdl-1.3 spdx 3 spdx licen[cs]e identifier gfdl 1 3 ~(only|or) ~later
gfdl-1.2 spdx 3 spdx licen[cs]e identifier gfdl 1 2 ~(only|or) ~later
gfdl-1.3 documentation 2 gnu free documentation licen[cs]e version 1 3
gfdl-1.2 documentation 2 gnu free documentation licen[cs]e version 1 2
gfdl documentation 1 gnu free documentation licen[cs]e
gfdl gnu 1 gnu g?fdl
gpl-exception classpath 2 gpl *4 with ~(the) classpath exception
gpl-exception exception 2 as a special exception *12 permission to link
bsd-3-clause spdx 3 spdx licen[cs]e identifier bsd 3 clause
bsd-3-clause bsd 2 bsd 3 clause
bsd-3-clause bsd 2 (3|three) clause bsd
bsd-3-clause bsd 2 (new|modified|revised) bsd licen[cs]e
bsd-3-clause neither 3 neither the name of *12 nor the names of its contributors may be used to endorse or promote products
bsd-3-clause opensource 3 opensource org licenses bsd 3 clause
bsd-2-clause spdx 3 spdx licen[cs]e identifier bsd 2 clause
bsd-2-clause bsd 2 bsd 2 clause
bsd-2-clause bsd 2 (2|two) clause bsd
bsd-2-clause bsd 2 (simplified|freebsd) bsd licen[cs]e
bsd-2-clause opensource 3 opensource org licenses bsd 2 clause
bsd-4-clause spdx 3 spdx licen[cs]e identifier bsd 4 clause
bsd-4-clause bsd 2 (4|four) clause bsd
bsd-4-clause bsd 2 original bsd licen[cs]e
bsd-4-clause advertising 3 all advertising materials mentioning features or use of this software must display the following
0bsd spdx 3 spdx licen[cs]e identifier 0bsd
0bsd bsd 2 (0|zero) clause bsd
bsd redistribution 2 redistribution and use in source and binary forms with or without modification are permitted
bsd bsd 1 bsd ~style licen[cs]ed?
bsd bsd 1 licen[cs]ed under ~the bsd
isc spdx 3 spdx licen[cs]e identifier isc
isc isc 2 isc licen[cs]e
isc permission 3 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib spdx 3 spdx licen[cs]e identifier zlib
zlib zlib 2 zlib ~libpng licen[cs]e
zlib altered 3 altered source versions must be plainly marked as such
libpng libpng 2 libpng licen[cs]e
bsl-1.0 spdx 3 spdx licen[cs]e identifier bsl 1 0
bsl-1.0 boost 3 boost software licen[cs]e ~version 1 0
bsl-1.0 boost 3 boost org license 1 0
bsl-1.0 boost 1 boost ~software licen[cs]e
busl-1.1 spdx 3 spdx licen[cs]e identifier busl 1 1
busl-1.1 business 2 business source licen[cs]e ~version 1 1
busl business 1 business source licen[cs]e
mpl-2.0 spdx 3 spdx licen[cs]e identifier mpl 2 0
mpl-2.0 mozilla 3 mozilla public licen[cs]e ~version v?2 0
mpl-2.0 mozilla 3 mozilla org mpl 2 0
mpl-2.0 mpl 2 mpl v?2 0
mpl-1.1 spdx 3 spdx licen[cs]e identifier mpl 1 1
mpl-1.1 mozilla 3 mozilla public licen[cs]e ~version v?1 1
mpl-1.1 mpl 2 mpl v?1 1
mpl-1.0 mozilla 3 mozilla public licen[cs]e ~version v?1 0
mpl mozilla 1 mozilla public licen[cs]e
epl-2.0 spdx 3 spdx licen[cs]e identifier epl 2 0
epl-2.0 eclipse 3 eclipse public licen[cs]e ~version v?2 0
epl-2.0 epl 2 epl v?2 0
epl-1.0 spdx 3 spdx licen[cs]e identifier epl 1 0
epl-1.0 eclipse 3 eclipse public licen[cs]e ~version v?1 0
epl-1.0 epl 2 epl v?1 0
epl eclipse 1 eclipse public licen[cs]e
edl-1.0 eclipse 2 eclipse distribution licen[cs]e ~version v?1 0
cddl-1.0 spdx 3 spdx licen[cs]e identifier cddl 1 0
cddl-1.1 spdx 3 spdx licen[cs]e identifier cddl 1 1
cddl-1.0 common 3 common development and distribution licen[cs]e *4 1 0
cddl-1.1 common 3 common development and distribution licen[cs]e *4 1 1
cddl common 1 common development and distribution licen[cs]e
cddl cddl 1 (the|under) cddl
cpl-1.0 common 2 common public licen[cs]e ~version v?1 0
cpl-1.0 spdx 3 spdx licen[cs]e identifier cpl 1 0
cpal-1.0 common 2 common public attribution licen[cs]e
eupl-1.2 spdx 3 spdx licen[cs]e identifier eupl 1 2
eupl-1.1 spdx 3 spdx licen[cs]e identifier eupl 1 1
eupl-1.2 european 3 european union public licen[cs]e ~version v?1 2
eupl-1.1 european 3 european union public licen[cs]e ~version v?1 1
eupl-1.2 eupl 2 eupl v?1 2
eupl european 1 european union public licen[cs]e
ms-pl spdx 3 spdx licen[cs]e identifier ms pl
ms-pl microsoft 2 microsoft public licen[cs]e
ms-rl spdx 3 spdx licen[cs]e identifier ms rl
ms-rl microsoft 2 microsoft reciprocal licen[cs]e
artistic-2.0 spdx 3 spdx licen[cs]e identifier artistic 2 0
artistic-2.0 artistic 3 artistic licen[cs]e ~version v?2 ~0
artistic-1.0 spdx 3 spdx licen[cs]e identifier artistic 1 0
artistic-1.0 artistic 3 artistic licen[cs]e ~version v?1 ~0
artistic artistic 1 artistic licen[cs]e
perl perl 2 under the same terms as perl itself
psf-2.0 spdx 3 spdx licen[cs]e identifier psf 2 0
psf python 2 python software foundation licen[cs]e ~version ~2
psf psf 2 psf licen[cs]e
python-2.0 spdx 3 spdx licen[cs]e identifier python 2 0
php-3.01 php 2 php licen[cs]e ~version v?3 01
php php 1 php licen[cs]e
ruby ruby 1 ruby licen[cs]e
openssl spdx 3 spdx licen[cs]e identifier openssl
openssl openssl 2 openssl licen[cs]e
openssl openssl 3 this product includes software developed by the openssl project
w3c spdx 3 spdx licen[cs]e identifier w3c
w3c w3c 2 w3c software ~(notice|and) *3 licen[cs]e
osl-3.0 spdx 3 spdx licen[cs]e identifier osl 3 0
osl-3.0 open 2 open software licen[cs]e ~version v?3 0
afl-3.0 academic 2 academic free licen[cs]e ~version v?3 0
afl-2.1 academic 2 academic free licen[cs]e ~version v?2 1
afl academic 1 academic free licen[cs]e
ecl-2.0 educational 2 educational community licen[cs]e ~version v?2 0
ncsa spdx 3 spdx licen[cs]e identifier ncsa
ncsa illinois 2 university of illinois ~ncsa open source licen[cs]e
ofl-1.1 spdx 3 spdx licen[cs]e identifier ofl 1 1
ofl-1.1 sil 3 sil open font licen[cs]e ~version v?1 1
ofl-1.1 scripts 3 scripts sil org ofl
ofl open 1 open font licen[cs]e
unlicense spdx 3 spdx licen[cs]e identifier unlicense
unlicense unlicense 2 the unlicense
unlicense unlicense 3 unlicense org
unlicense unencumbered 3 this is free and unencumbered software released into the public domain
wtfpl spdx 3 spdx licen[cs]e identifier wtfpl
wtfpl wtfpl 2 wtfpl
wtfpl fuck 3 do what the fuck you want to public licen[cs]e
beerware beer 2 the (beer|beerware) ~ware licen[cs]e
json evil 3 the software shall be used for good not evil
postgresql spdx 3 spdx licen[cs]e identifier postgresql
postgresql postgresql 2 postgresql licen[cs]e
sspl-1.0 spdx 3 spdx licen[cs]e identifier sspl 1 0
sspl-1.0 server 2 server side public licen[cs]e
elastic-2.0 elastic 2 elastic licen[cs]e ~version v?2 0
elastic elastic 1 elastic licen[cs]e
commons-clause commons 2 commons clause ~licen[cs]e ~condition
polyform polyform 2 polyform (noncommercial|small|strict|perimeter|shield|free) *2 licen[cs]e
hippocratic hippocratic 2 hippocratic licen[cs]e
odbl-1.0 spdx 3 spdx licen[cs]e identifier odbl 1 0
odbl open 2 open database licen[cs]e
odbl opendatacommons 3 opendatacommons org licenses odbl
odc-by opendatacommons 3 opendatacommons org licenses by
odc-by open 2 open data commons attribution licen[cs]e
pddl opendatacommons 3 opendatacommons org licenses pddl
pddl public 2 public domain dedication and licen[cs]e
cdla-permissive-2.0 community 2 community data licen[cs]e agreement permissive ~version ~2
cdla-sharing-1.0 community 2 community data licen[cs]e agreement sharing ~version ~1
ogl-3.0 open 2 open government licen[cs]e v3 ~0
ogl open 1 open government licen[cs]e
etalab licence 2 licence ouverte ~open ~licence ~(etalab|version)
cc0 spdx 3 spdx licen[cs]e identifier cc0 1 0
cc0 cc0 2 cc0 ~1 ~0
cc0 creative 3 creative commons (zero|cc0) ~1 ~0
cc0 creativecommons 3 creativecommons org publicdomain zero
public-domain creativecommons 3 creativecommons org publicdomain mark
cc-by spdx 3 spdx licen[cs]e identifier cc by [1234] [05]
cc-by cc 2 cc by [1234] [05]
cc-by creativecommons 3 creativecommons org licenses by [1234] [05]
cc-by creative 2 creative commons attribution ~(licen[cs]e|international|generic|unported|[1234]) ~[05]
cc-by-sa spdx 3 spdx licen[cs]e identifier cc by sa [1234] [05]
cc-by-sa cc 2 cc by sa ~[1234] ~[05]
cc-by-sa creativecommons 3 creativecommons org licenses by sa
cc-by-sa creative 3 creative commons attribution (sharealike|share) ~alike
cc-by-sa creative 3 attribution sharealike creative commons
cc-by-nd spdx 3 spdx licen[cs]e identifier cc by nd [1234] [05]
cc-by-nd cc 2 cc by nd ~[1234] ~[05]
cc-by-nd creativecommons 3 creativecommons org licenses by nd
cc-by-nd creative 3 creative commons attribution (noderivatives|no) ~derivatives
cc-by-nc spdx 3 spdx licen[cs]e identifier cc by nc [1234] [05]
cc-by-nc cc 3 licen[cs]ed under ~a ~the cc by nc [1234] [05]
cc-by-nc creativecommons 3 creativecommons org licenses by nc [1234]
cc-by-nc creative 3 creative commons attribution (noncommercial|non) ~commercial
cc-by-nc creative 3 attribution noncommercial creative commons
cc-by-nc-sa cc 3 cc by nc sa ~[1234] ~[05]
cc-by-nc-sa creativecommons 3 creativecommons org licenses by nc sa
cc-by-nc-sa creative 3 creative commons attribution (noncommercial|non) ~commercial (sharealike|share) ~alike
cc-by-nc-nd cc 3 cc by nc nd ~[1234] ~[05]
cc-by-nc-nd creativecommons 3 creativecommons org licenses by nc nd
cc-by-nc-nd creative 3 creative commons attribution (noncommercial|non) ~commercial (no|noderiv[a-z]*) ~deriv[a-z]*
cc creative 1 creative commons ~public ~licen[cs]e
cc creative 1 licencia creative commons
cc creative 1 licence creative commons
cc creative 1 creative commons lizenz
public-domain public 2 (released|placed|dedicated|is) ~in ~to ~into the public domain
public-domain public 1 public domain
public-domain domaine 1 domaine public
public-domain gemeinfrei 1 gemeinfrei
proprietary reserved 2 all rights reserved
proprietary reservados 2 todos los derechos reservados
proprietary droits 2 tous droits réservés
proprietary rechte 2 alle rechte vorbehalten
proprietary proprietary 2 proprietary and confidential
proprietary redistribution 2 (unauthorized|no) ~(copying|redistribution) *6 redistribution ~is ~strictly prohibited
copyright copyright 1 copyright ~c (19|20)[0-9][0-9]
free-licen lizenz 1 (freie|freien) lizenz
free-licen licencia 1 licencia (libre|pública)
free-licen licence 1 licence (libre|publique)
spdx spdx 1 spdx licen[cs]e identifier [a-z0-9]+
"""
