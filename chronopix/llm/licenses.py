"""License scan by ordered signature rules.

A text becomes its lower-case words (ASCII letters and digits, and whatever is
beyond ASCII), joined by one space, so that a license's name, its SPDX tag and
its address look alike.  Each rule is a regular expression over whole words; an
Aho-Corasick pass finds which rules' keywords occur, and only those rules run.
Rules have a priority by their place.  Of overlapping detections, one that lies
inside another of the same or a better priority is dropped, and of two that
cross, the one of worse priority.

Three base phrases are always counted and labelled: ``cc by``, ``general public
license`` and ``all rights reserved``.

Defined results: null, empty and wordless texts have no words, places or labels,
null first and last word and score 0; very long texts are read whole; repeated
rows and other columns make no difference.
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopix.llm.common import map_batches

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_BASE = re.compile("(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )")
_BASE_LABEL = dict(BASE)
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

# One rule a line: label, keyword, expression over space-joined words.  Earlier sections win over later ones.
# Whatever the expression matches has a word that begins with the keyword, or with one of several parted by |.
_RULES = """
# tags and addresses
apache-2.0      apache      spdx license identifier apache 2 0
apache-2.0      apache      (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1      apache      spdx license identifier apache 1 1
apache-1.1      apache      apache org licenses license 1 1
mit             mit         spdx license identifier mit
mit             mit         opensource org licenses? mit(?: license)?(?: php| html)?
mit-0           mit         spdx license identifier mit 0
bsd-2-clause    bsd         spdx license identifier bsd 2 clause
bsd-3-clause    bsd         spdx license identifier bsd 3 clause
bsd-2-clause    bsd         opensource org licenses? bsd 2 clause
bsd-3-clause    bsd         opensource org licenses? bsd 3 clause
bsd-3-clause    bsd         opensource org licenses? bsd license(?: php)?
isc             isc         spdx license identifier isc
isc             isc         opensource org licenses? isc
zlib            zlib        spdx license identifier zlib
mpl-2.0         mpl         spdx license identifier mpl 2 0
mpl-2.0         mpl         mozilla org mpl 2 0
mpl-1.1         mpl         spdx license identifier mpl 1 1
mpl-1.1         mpl         mozilla org mpl mpl 1 1
gpl-2.0-or-later    gpl     spdx license identifier gpl 2 0 or later
gpl-3.0-or-later    gpl     spdx license identifier gpl 3 0 or later
gpl-2.0-only    gpl         spdx license identifier gpl 2 0(?: only)?
gpl-3.0-only    gpl         spdx license identifier gpl 3 0(?: only)?
lgpl-2.1-or-later   lgpl    spdx license identifier lgpl 2 1 or later
lgpl-3.0-or-later   lgpl    spdx license identifier lgpl 3 0 or later
lgpl-2.1-only   lgpl        spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-only   lgpl        spdx license identifier lgpl 3 0(?: only)?
agpl-3.0-or-later   agpl    spdx license identifier agpl 3 0 or later
agpl-3.0-only   agpl        spdx license identifier agpl 3 0(?: only)?
gpl-2.0-only    gnu         gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html| en html)?
gpl-3.0-only    gnu         gnu org licenses gpl 3 0(?: txt| html| en html)?
lgpl-2.1-only   gnu         gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html| en html)?
lgpl-3.0-only   gnu         gnu org licenses lgpl 3 0(?: txt| html| en html)?
agpl-3.0-only   gnu         gnu org licenses agpl 3 0(?: txt| html| en html)?
gfdl-1.3        gnu         gnu org licenses fdl 1 3(?: txt| html)?
epl-1.0         epl         spdx license identifier epl 1 0
epl-2.0         epl         spdx license identifier epl 2 0
epl-1.0         eclipse     eclipse org legal epl v10(?: html)?
epl-2.0         eclipse     eclipse org legal epl (?:2 0|v20)(?: html)?
cddl-1.0        cddl        spdx license identifier cddl 1 0
cddl-1.1        cddl        spdx license identifier cddl 1 1
cc0-1.0         cc0         spdx license identifier cc0 1 0
unlicense       unlicense   spdx license identifier unlicense
unlicense       unlicense   unlicense org
wtfpl           wtfpl       spdx license identifier wtfpl
wtfpl           wtfpl       wtfpl net
bsl-1.0         bsl         spdx license identifier bsl 1 0
bsl-1.0         boost       boost org license 1 0(?: txt)?
artistic-2.0    artistic    spdx license identifier artistic 2 0
artistic-2.0    artistic    opensource org licenses? artistic(?: license)? 2 0
eupl-1.1        eupl        spdx license identifier eupl 1 1
eupl-1.2        eupl        spdx license identifier eupl 1 2
osl-3.0         osl         spdx license identifier osl 3 0
afl-3.0         afl         spdx license identifier afl 3 0
ms-pl           ms          spdx license identifier ms pl
ms-rl           ms          spdx license identifier ms rl
ofl-1.1         ofl         spdx license identifier ofl 1 1
ofl-1.1         ofl         scripts sil org ofl
odbl-1.0        odbl        spdx license identifier odbl 1 0
odbl-1.0        odbl        opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0      odc         spdx license identifier odc by 1 0
pddl-1.0        pddl        opendatacommons org licenses pddl(?: 1 0)?
pddl-1.0        pddl        spdx license identifier pddl 1 0
postgresql      postgresql  spdx license identifier postgresql
ncsa            ncsa        spdx license identifier ncsa
python-2.0      python|psf  spdx license identifier (?:python|psf) 2 0
ruby            ruby        spdx license identifier ruby
php-3.01        php         spdx license identifier php 3 01
php-3.01        php         php net license 3 01(?: txt)?
mulan-psl-2.0   mulan       spdx license identifier mulanpsl 2 0
bsl-1.1         busl        spdx license identifier busl 1 1
sspl-1.0        sspl        spdx license identifier sspl 1 0
elastic-2.0     elastic     spdx license identifier elastic 2 0
0bsd            0bsd        spdx license identifier 0bsd
# full texts and grants
mit             permission  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit             merchantability     the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit             substantial     the above copyright notice and this permission notice shall be included in all copies or substantial portions
bsd-3-clause    endorse     neither the names? of .{1,120}? may be used to endorse or promote products derived from this software
bsd-2-clause    redistribution  redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause    advertising     all advertising materials mentioning features or use of this software must display
isc             permission  permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
zlib            misrepresented  the origin of this software must not be misrepresented
apache-2.0      apache      licensed under the apache license version 2 0
apache-2.0      contributor     each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free
gpl-2.0-or-later    gnu     gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later    gnu     gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later   gnu     gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later   gnu     gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0-or-later   gnu     gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only    gnu         gnu general public license version 2 as published by the free software foundation
gpl-3.0-only    gnu         gnu general public license version 3 as published by the free software foundation
mpl-2.0         mozilla     this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1         mozilla     the contents of this file are subject to the mozilla public license version 1 1
cddl-1.0        distribution    the contents of this file are subject to the terms of the common development and distribution license
epl-1.0         eclipse     this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0         eclipse     this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0
unlicense       unencumbered    this is free and unencumbered software released into the public domain
wtfpl           verbatim    everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
bsl-1.0         boost       distributed under the boost software license version 1 0
ofl-1.1         font        this font software is licensed under the sil open font license version 1 1
artistic-2.0    artistic    you may use this (?:package|software) under the terms of the artistic license 2 0
postgresql      postgresql  this software is released under the postgresql licen[cs]e
openssl         openssl     this product includes software developed by the openssl project
cc0-1.0         waived      to the extent possible under law .{1,160}? has waived all copyright and related
beerware        beer        if we meet some day and you think this stuff is worth it you can buy me a beer
json            evil        the software shall be used for good not evil
x11             consortium  except as contained in this notice the name of the x consortium
curl            advertising     except as contained in this notice the name of a copyright holder shall not be used in advertising
hpnd            permission  permission to use copy modify and distribute this software and its documentation for any purpose
# names with version
apache-2.0      apache      (?:the )?apache (?:software )?(?:licen[cs]e )?(?:v ?|version )?2(?: 0)?(?: licen[cs]e)?
apache-1.1      apache      apache (?:software )?licen[cs]e (?:v ?|version )?1 1
apache-1.0      apache      apache (?:software )?licen[cs]e (?:v ?|version )?1 0
agpl-3.0-or-later   affero  (?:gnu )?affero general public license (?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?
agpl-3.0        affero      (?:gnu )?affero general public license (?:v ?|version )?3(?: 0)?
agpl-3.0        agpl        (?:gnu )?agpl ?(?:v ?|version )?3(?: 0)?
agpl-3.0        agplv3      (?:gnu )?agplv3
lgpl-2.1-or-later   lesser  (?:gnu )?lesser general public license (?:v ?|version )?2 1 or (?:any )?later(?: version)?
lgpl-3.0-or-later   lesser  (?:gnu )?lesser general public license (?:v ?|version )?3(?: 0)? or (?:any )?later(?: version)?
lgpl-2.0        library     (?:gnu )?library general public license(?: (?:v ?|version )?2(?: 0)?)?
lgpl-2.1        lesser      (?:gnu )?lesser general public license (?:v ?|version )?2 1
lgpl-3.0        lesser      (?:gnu )?lesser general public license (?:v ?|version )?3(?: 0)?
lgpl-2.1        lgpl        (?:gnu )?lgpl (?:v ?|version )?2 1
lgpl-3.0        lgpl        (?:gnu )?lgpl (?:v ?|version )?3(?: 0)?
lgpl-2.1        lgplv2      (?:gnu )?lgplv2(?: 1)?
lgpl-3.0        lgplv3      (?:gnu )?lgplv3
gpl-2.0-or-later    general (?:gnu )?general public license (?:v ?|version )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later    general (?:gnu )?general public license (?:v ?|version )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0         general     (?:gnu )?general public license (?:v ?|version )?2(?: 0)?
gpl-3.0         general     (?:gnu )?general public license (?:v ?|version )?3(?: 0)?
gpl-1.0         general     (?:gnu )?general public license (?:v ?|version )?1(?: 0)?
gpl-2.0         gpl         (?:gnu )?gpl (?:v ?|version )?2(?: 0)?
gpl-3.0         gpl         (?:gnu )?gpl (?:v ?|version )?3(?: 0)?
gpl-2.0         gplv2       (?:gnu )?gplv2
gpl-3.0         gplv3       (?:gnu )?gplv3
gpl-2.0         gpl2        gpl2
gpl-3.0         gpl3        gpl3
gfdl-1.3        documentation   (?:gnu )?free documentation license (?:v ?|version )?1 3
gfdl-1.2        documentation   (?:gnu )?free documentation license (?:v ?|version )?1 2
gfdl-1.1        documentation   (?:gnu )?free documentation license (?:v ?|version )?1 1
mpl-2.0         mozilla     mozilla public license (?:v ?|version )?2(?: 0)?
mpl-1.1         mozilla     mozilla public license (?:v ?|version )?1 1
mpl-1.0         mozilla     mozilla public license (?:v ?|version )?1 0
mpl-2.0         mpl         mpl (?:v ?|version )?2(?: 0)?
mpl-2.0         mplv2       mplv2(?: 0)?
epl-1.0         eclipse     eclipse public license (?:v ?|version )?1(?: 0)?
epl-2.0         eclipse     eclipse public license (?:v ?|version )?2(?: 0)?
cddl-1.0        distribution    common development and distribution license (?:v ?|version )?1(?: 0)?
cddl-1.1        distribution    common development and distribution license (?:v ?|version )?1 1
cpl-1.0         common      common public license (?:v ?|version )?1(?: 0)?
ipl-1.0         ibm         ibm public license (?:v ?|version )?1(?: 0)?
bsl-1.0         boost       boost software license (?:v ?|version )?1(?: 0)?
bsd-2-clause    bsd         (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2-clause    bsd         bsd (?:2|two) clause(?: simplified)?(?: licen[cs]e)?
bsd-3-clause    bsd         (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3-clause    bsd         bsd (?:3|three) clause(?: new| revised)?(?: or revised)?(?: licen[cs]e)?
bsd-4-clause    bsd         (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
bsd-4-clause    bsd         bsd (?:4|four) clause(?: licen[cs]e)?
0bsd            bsd         (?:zero clause|0 clause) bsd(?: licen[cs]e)?
0bsd            0bsd        0bsd
artistic-1.0    artistic    artistic license (?:v ?|version )?1(?: 0)?
artistic-2.0    artistic    artistic license (?:v ?|version )?2(?: 0)?
afl-2.1         academic    academic free license (?:v ?|version )?2 1
afl-3.0         academic    academic free license (?:v ?|version )?3(?: 0)?
osl-2.1         open        open software license (?:v ?|version )?2 1
osl-3.0         open        open software license (?:v ?|version )?3(?: 0)?
eupl-1.1        union       european union public licen[cs]e (?:v ?|version )?1 1
eupl-1.2        union       european union public licen[cs]e (?:v ?|version )?1 2
eupl-1.2        eupl        eupl (?:v ?|version )?1 2
ofl-1.1         font        (?:sil )?open font license(?: (?:v ?|version )?1 1)?
ofl-1.0         font        (?:sil )?open font license (?:v ?|version )?1 0
odbl-1.0        database    open database license(?: (?:v ?|version )?1 0)?
odbl-1.0        odbl        odbl(?: (?:v ?|version )?1 0)?
odc-by-1.0      attribution     open data commons attribution(?: license)?(?: (?:v ?|version )?1 0)?
pddl-1.0        domain      public domain dedication and license(?: (?:v ?|version )?1 0)?
cdla-permissive-2.0     cdla    cdla permissive (?:v ?|version )?2 0
cdla-permissive-1.0     cdla    cdla permissive (?:v ?|version )?1 0
cdla-sharing-1.0    cdla    cdla sharing (?:v ?|version )?1 0
zpl-2.1         zope        zope public license (?:v ?|version )?2 1
zpl-2.0         zope        zope public license (?:v ?|version )?2 0
php-3.01        php         php license (?:v ?|version )?3 01
php-3.0         php         php license (?:v ?|version )?3 0
python-2.0      python      python (?:software foundation )?license(?: (?:v ?|version )?2(?: 0)?)?
lppl-1.3        latex       latex project public license(?: (?:v ?|version )?1 3(?:a|c)?)?
qpl-1.0         q           q public license(?: (?:v ?|version )?1 0)?
upl-1.0         universal   universal permissive license(?: (?:v ?|version )?1 0)?
apsl-2.0        apple       apple public source license(?: (?:v ?|version )?2 0)?
nposl-3.0       profit      non profit open software license(?: (?:v ?|version )?3 0)?
rpl-1.5         reciprocal  reciprocal public license(?: (?:v ?|version )?1 5)?
cecill-2.1      cecill      cecill(?: free software license agreement)?(?: (?:v ?|version )?2 1)?
cecill-b        cecill      cecill b
cecill-c        cecill      cecill c
ecl-2.0         educational     educational community license(?: (?:v ?|version )?2 0)?
mulan-psl-2.0   mulan       mulan (?:psl|permissive software license)(?: (?:v ?|version )?2)?
bsl-1.1         business    business source license(?: (?:v ?|version )?1 1)?
sspl-1.0        server      server side public license(?: (?:v ?|version )?1)?
elastic-2.0     elastic     elastic license(?: (?:v ?|version )?2(?: 0)?)?
cal-1.0         cryptographic   cryptographic autonomy license(?: (?:v ?|version )?1 0)?
parity-7.0      parity      parity public license(?: (?:v ?|version )?7(?: 0)?)?
polyform-noncommercial-1.0      polyform    polyform noncommercial license(?: (?:v ?|version )?1 0 0)?
openrail-m      openrail    (?:creativeml |bigscience )?openrail m?
# names without version
mit             mit         (?:the )?mit (?:expat )?licen[cs]e
mit             mit         (?:under|licensed|license|licence) (?:the )?mit
mit             expat       expat licen[cs]e
x11             x11         x11 licen[cs]e
isc             isc         isc licen[cs]e
ncsa            illinois    university of illinois(?: ncsa)? open source license
zlib            zlib        zlib(?: libpng)? licen[cs]e
unlicense       unlicense   (?:the )?unlicense
wtfpl           wtfpl       wtfpl
wtfpl           what        do what the fuck you want to public license
beerware        beerware    beerware(?: licen[cs]e)?
cc0-1.0         cc0         (?:creative commons )?cc0(?: 1 0)?(?: universal)?
ms-pl           microsoft   microsoft public license
ms-rl           microsoft   microsoft reciprocal license
apache          apache      apache (?:software )?licen[cs]e
bsd             bsd         bsd(?: style)? licen[cs]e
artistic        artistic    artistic licen[cs]e
mpl             mozilla     mozilla public licen[cs]e
epl             eclipse     eclipse public licen[cs]e
cddl            cddl        cddl
cddl            distribution    common development and distribution licen[cs]e
agpl            affero      (?:gnu )?affero general public licen[cs]e
agpl            agpl        (?:gnu )?agpl
lgpl            lesser      (?:gnu )?lesser general public licen[cs]e
lgpl            lgpl        (?:gnu )?lgpl
gpl             general     gnu general public licen[cs]e
gpl             gpl         (?:gnu )?gpl
gfdl            documentation   (?:gnu )?free documentation licen[cs]e
eupl            eupl        eupl
postgresql      postgresql  postgresql licen[cs]e
openssl         openssl     openssl licen[cs]e
ruby            ruby        ruby licen[cs]e
vim             vim         vim licen[cs]e
perl            perl        same terms as perl(?: 5)?(?: itself)?
# broad statements
creative-commons    creative    (?:a )?creative commons (?:public )?licen[cs]e
public-domain   domain      (?:in|into|to) the public domain
public-domain   domain      public domain(?: work| mark)
no-rights-reserved  rights  no rights reserved
some-rights-reserved    rights  some rights reserved
proprietary     proprietary|confidential    (?:proprietary|confidential) and (?:confidential|proprietary)
proprietary     unauthorized    unauthorized (?:copying|reproduction|distribution|use)(?: and or (?:copying|distribution))? (?:of this .{1,60}? )?is (?:strictly )?prohibited
proprietary     permission  may not be (?:reproduced|copied|distributed|republished)(?: .{1,80}?)? without (?:the )?(?:prior |express )?(?:written )?permission
non-commercial  commercial|noncommercial    (?:for )?non ?commercial (?:use|purposes) only
permission      permission  (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission
terms           terms       terms (?:of (?:use|service)|and conditions) apply
copyright       copyright   copyright (?:c |© )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright       ©           © ?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
"""


def _creative_commons() -> list[tuple[str, str, str, int]]:
    """Creative Commons: every variant and version in its tag, address and full name."""
    parts = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    out = []
    for variant in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        tag, name = variant.replace("-", " "), " ".join(parts[p] for p in variant.split("-"))
        for version in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            v = version.replace(".", " ")
            out.append((f"cc-{variant}-{version}", "creativecommons", f"creativecommons org licenses {tag} {v}", 0))
            out.append((f"cc-{variant}-{version}", "cc", f"(?:spdx license identifier )?cc {tag} {v}(?: (?:international|unported))?", 0))
            out.append((f"cc-{variant}-{version}", "creative", f"creative commons {name}(?: licen[cs]e)?(?: international| unported)? (?:v ?|version )?{v}(?: (?:international|unported|generic))?(?: licen[cs]e)?", 2))
        out.append((f"cc-{variant}", "cc", f"cc {tag}", 3))
        out.append((f"cc-{variant}", "creativecommons", f"creativecommons org licenses {tag}", 3))
        out.append((f"cc-{variant}", "creative", f"creative commons {name}(?: licen[cs]e)?", 3))
    out.append(("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?", 0))
    out.append(("public-domain", "creativecommons", "creativecommons org publicdomain mark(?: 1 0)?", 0))
    return out


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    section: int


def rules() -> list[Rule]:
    """All rules, best priority first."""
    raw = _creative_commons()
    section = -1
    for line in _RULES.strip().split("\n"):
        if line.startswith("#"):
            section += 1
            continue
        label, keyword, pattern = line.split(None, 2)
        raw.append((label, keyword, pattern, section))
    raw.sort(key=lambda r: r[3])
    return [Rule(label, keyword, re.compile(f"(?<= )(?:{pattern})(?= )"), section) for label, keyword, pattern, section in raw]


#: How sure a rule of each section is.
STRENGTH = (0.99, 0.95, 0.9, 0.8, 0.5)


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]  # (word, label) of every place of a base phrase
    detections: list[tuple[int, int, str, int]]  # (first word, words, label, section) that stay

    @property
    def score(self) -> float:
        """1 less the product of the doubts of the distinct labels; a base phrase counts as a broad statement."""
        best: dict[str, float] = {label: STRENGTH[4] for _, label in self.base}
        for _, _, label, section in self.detections:
            best[label] = max(best.get(label, 0.0), STRENGTH[section])
        doubt = 1.0
        for _, v in sorted(best.items()):
            doubt *= 1 - v
        return 1 - doubt


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        by: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for keyword in r.keyword.split("|"):
                by.setdefault(keyword, []).append(k)
        self.gate = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.gate.add_word(f" {keyword}", own)
        self.gate.make_automaton()

    def scan(self, text: str | None) -> Scan:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        if not words:
            return Scan(0, [], [])
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        gated: set[int] = set()
        for _, own in self.gate.iter(line):
            gated.update(own)
        base = [(m.start(), _BASE_LABEL[m.group()]) for m in _BASE.finditer(line)]
        found = []
        for k in sorted(gated):
            found += [(k, *m.span()) for m in self.rules[k].pattern.finditer(line)]
        kept: list[tuple[int, int, int]] = []  # (start, end, rule), by place; they don't overlap
        # best priority first; within one the longest: what overlaps a kept one of the same or better priority goes
        for k, start, end in sorted(found, key=lambda f: (self.rules[f[0]].section, f[1] - f[2], f[0], f[1])):
            i = bisect(kept, (start, end, k))
            if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or end <= kept[i][0]):
                kept.insert(i, (start, end, k))
        # places in words, by counting spaces once from left to right
        spots = sorted({p for p, _ in base} | {a for a, _, _ in kept})
        word, before, n = {}, 0, -1
        for p in spots:
            n += line.count(" ", before, p)
            before, word[p] = p, n
        detections = [(word[a], line.count(" ", a, b) + 1, self.rules[k].label, self.rules[k].section) for a, b, k in kept]
        return Scan(len(words), [(word[p], label) for p, label in base], detections)


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, base places and labels, all labels, detections, score) of every document."""

    def make():
        scanner = Scanner()

        def fn(ids, texts):
            out = [[], [], [], [], [], [], [], [], []]
            for key, text in zip(ids, texts, strict=True):
                s = scanner.scan(text)
                places = [p for p, _ in s.base]
                base = sorted({x for _, x in s.base})
                every = sorted({*base, *(d[2] for d in s.detections)})
                row = (key, s.n_words, len(places), min(places, default=None), max(places, default=None), base, every, [f"{d[0]}+{d[1]} {d[2]}" for d in s.detections], s.score)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return out

        return fn

    kind = dict(documents.dtypes)[id_column]
    return map_batches(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), make, ["id", "text"], f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, detections array<string>, score double")
