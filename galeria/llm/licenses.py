"""License scan with ordered signature rules, in DataFrame functions only.

Rules are hand-written regular expressions over a text's normalised words: wordings of
whole licenses, notices and headers, and the names and identifiers of the license families
in five forms. A rule runs only on texts that hold one of its keywords, and none runs on a
text without any cue; both are implied by the rules, so nothing is lost. Overlapping
detections are resolved by priority and containment: a detection inside another one of the
same or a better priority is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.llm.common import ascii_lower, fresh, running, table

# Fixed values of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Wordings of license texts: (label, keyword, words). Confidence 1, priority 1.
TEXTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of (?:this software and associated documentation files|the software and associated documentation)(?: the software)?"),
    ("mit", "sublicense and or sell", "(?:rights to )?use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "above copyright notice and this permission", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("isc", "this software for any purpose with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "this software for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: of the software| of the code)?(?: as well as documentation)? with or without modification (?:are|is) permitted"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,12}?(?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse or promote products", "the names? of (?:the )?(?:[^ ]+ ){1,8}?may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache", "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache", "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache", "except in compliance with the license", "you may not use this (?:file|work|software|program) except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "gnu general public license as published", "under the terms of the gnu general public license as published by the free software foundation(?: either)?(?: version [0-9](?: of the license)?)?"),
    ("gpl", "gnu general public license", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu general public license", "see the gnu general public license for more details"),
    ("gpl", "free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "licenses for most software are designed", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("lgpl", "gnu lesser general public license as published", "under the terms of the gnu lesser general public license as published by the free software foundation(?: either)?(?: version [0-9](?: [0-9])?(?: of the license)?)?"),
    ("lgpl", "gnu library general public license as published", "under the terms of the gnu library general public license as published by the free software foundation(?: either)?(?: version [0-9](?: of the license)?)?"),
    ("lgpl", "gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "gnu lesser general public license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", "gnu affero general public license as published", "under the terms of the gnu affero general public license as published by the free software foundation(?: either)?(?: version [0-9](?: of the license)?)?"),
    ("agpl", "gnu affero general public license", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "gnu affero general public license", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version [0-9](?: [0-9])?)?"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?[0-9](?: [0-9])?"),
    ("mpl", "mozilla public license", "the contents of this file are subject to the mozilla public license version [0-9](?: [0-9])?"),
    ("mpl", "if a copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)? ?[0-9](?: [0-9])?)?"),
    ("cddl", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "common public license", "the accompanying program is provided under the terms of this common public license"),
    ("bsl", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "claim that you wrote the original software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "permission is granted to anyone to use this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want to public license", "do what the fuck you want to public license(?: version [0-9])?"),
    ("wtfpl", "you just do what", "0 you just do what the fuck you want to"),
    ("beerware", "buy me a beer", "(?:as long as you retain this notice )?you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("artistic", "everyone is permitted to copy and distribute verbatim copies of this license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("artistic", "artistic control", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("psf", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php", "php software freely available from", "this product includes php software freely available from"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl toolkit and openssl project", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("ofl", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software"),
    ("ofl", "font software", "this font software is licensed under the sil open font license(?: version [0-9] [0-9])?"),
    ("ncsa", "deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "use or other dealings in this software", "the names? of (?:the )?(?:[^ ]+ ){1,8}?shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("curl", "copyright holder shall not be used in advertising", "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization of the copyright holder"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "this software and its documentation for any purpose", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("vim", "copies of vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("vim", "copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", "w3c", "by obtaining(?: using and or copying)? this work you the licensee agree that you have read understood and will comply with the following terms and conditions permission to copy modify and distribute this (?:work|software) w3c"),
    ("upl", "universal permissive license", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the software (?:[^ ]+ ){0,40}?universal permissive license"),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software if you use the software you accept this license (?:[^ ]+ ){0,40}?microsoft public license"),
    ("eupl", "european union public licence", "this european union public licence the eupl applies to the work"),
    ("cecill", "cecill", "this software is governed by the cecill(?: [abc])? license under french law and abiding by the rules of distribution of free software"),
    ("osl", "open software license", "licensed under the open software license version [0-9] [0-9]"),
    ("afl", "academic free license", "licensed under the academic free license version [0-9] [0-9]"),
    ("sspl", "server side public license", "under the terms of the server side public license version 1 as published by mongodb"),
    ("busl", "business source license", "use of this software is governed by the business source license"),
    ("busl", "change date", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("elastic", "elastic license", "or more contributor license agreements licensed under the elastic license"),
    ("odbl", "open database license", "this (?:[^ ]+ ){1,6}?is made available under the open database license"),
    ("odc-by", "open data commons attribution license", "made available under the open data commons attribution license"),
    ("pddl", "public domain dedication and license", "made available under the public domain dedication and license"),
    ("cc0", "no copyright", "the person who associated a work with this deed has dedicated the work to the public domain(?: by waiving)? (?:[^ ]+ ){0,20}?no copyright"),
    ("cc0", "dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "waived all copyright", "to the extent possible under law (?:[^ ]+ ){1,12}?(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons attribution", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution [0-9] 0 international public license"),
    ("cc-by-sa", "creative commons attribution share", "bound by the terms and conditions of this creative commons attribution share ?alike [0-9] 0 international public license"),
    ("cc-by-nc", "creative commons attribution non", "bound by the terms and conditions of this creative commons attribution non ?commercial [0-9] 0 international public license"),
    ("public-domain", "public domain", "(?:is|are|was|has been|have been|being)(?: hereby)? (?:placed|put|dedicated|released) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved (?:[^ ]+ ){0,6}?(?:no part of this|unauthori[sz]ed (?:copying|use|reproduction|distribution))"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|work|document))?(?: via any medium)? is strictly prohibited"),
)
#: Notices and addresses: (label, keyword, words). Confidence 0.97, priority 2.
NOTICES = (
    ("apache", "apache org licenses", "(?:http )?(?:https )?(?:www )?apache org licenses license [0-9] [0-9]"),
    ("apache", "asf under one or more contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "gnu org licenses gpl", "gnu org licenses gpl(?: [0-9] [0-9])?"),
    ("gpl", "gnu org copyleft gpl", "gnu org copyleft gpl"),
    ("lgpl", "gnu org licenses lgpl", "gnu org licenses lgpl(?: [0-9] [0-9])?"),
    ("lgpl", "gnu org copyleft lesser", "gnu org copyleft lesser"),
    ("agpl", "gnu org licenses agpl", "gnu org licenses agpl(?: [0-9] [0-9])?"),
    ("gfdl", "gnu org licenses fdl", "gnu org licenses fdl(?: [0-9] [0-9])?"),
    ("mpl", "mozilla org mpl", "mozilla org mpl(?: [0-9] [0-9])?"),
    ("mpl", "mozilla org en us mpl", "mozilla org en us mpl(?: [0-9] [0-9])?"),
    ("epl", "eclipse org legal epl", "eclipse org legal epl(?: ?v[0-9]+)?"),
    ("bsl", "boost org license", "boost org license 1 0"),
    ("mit", "opensource org licenses mit", "opensource org licenses mit(?: license php)?"),
    ("isc", "opensource org licenses isc", "opensource org licenses isc"),
    ("bsd", "opensource org licenses bsd", "opensource org licenses bsd(?: [0-9] clause| license php)?"),
    ("zlib", "opensource org licenses zlib", "opensource org licenses zlib"),
    ("artistic", "opensource org licenses artistic", "opensource org licenses artistic(?: license)?(?: [0-9] [0-9])?"),
    ("ms-pl", "opensource org licenses ms pl", "opensource org licenses ms pl"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("ofl", "scripts sil org ofl", "scripts sil org ofl"),
    ("odbl", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: [0-9] [0-9])?"),
    ("odc-by", "opendatacommons org licenses by", "opendatacommons org licenses by(?: [0-9] [0-9])?"),
    ("pddl", "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: [0-9] [0-9])?"),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero(?: [0-9] [0-9])?"),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by(?: [0-9] [0-9])?"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd(?: [0-9] [0-9])?"),
    ("python", "python org psf license", "python org psf license"),
    ("eupl", "joinup ec europa eu", "joinup ec europa eu (?:software page|collection eupl)(?: eupl)?"),
    ("cecill", "cecill info", "cecill info(?: licences)?"),
    ("bsd", "bsd style license that can be found", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("mit", "mit style license that can be found", "use of this source code is governed by an mit style license that can be found in the license file"),
    ("bsd", "dual bsd gpl", "module license dual bsd gpl"),
    ("gpl", "module license gpl", "module license gpl(?: v2)?"),
    ("perl", "same terms as perl itself", "(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("psf", "python software foundation license", "python software foundation license(?: version [0-9])?"),
    ("cc-by", "some rights reserved", "creative commons some rights reserved"),
)

#: label: (keywords, name as it stands before "license", identifier in words).
FAMILIES = {
    "mit": ("mit|expat", "(?:mit(?: expat)?|expat)", "mit", "(?:mit|expat)"),
    "apache": ("apache|asl", "apache(?: software)?", "apache", "(?:apache(?:v[0-9])?|asl)"),
    "gpl": ("gpl|general public", "(?:gnu )?general public", "gpl", "(?:gnu )?gpl(?:v?[0-9])?"),
    "lgpl": ("lgpl|lesser general|library general", "(?:gnu )?(?:lesser|library) general public", "lgpl", "(?:gnu )?lgpl(?:v?[0-9])?"),
    "agpl": ("agpl|affero", "(?:gnu )?affero general public", "agpl", "(?:gnu )?agpl(?:v?[0-9])?"),
    "gfdl": ("gfdl|free documentation", "(?:gnu )?free documentation", "gfdl"),
    "mpl": ("mpl|mozilla", "mozilla public", "mpl", "mpl(?:v?[0-9])?"),
    "epl": ("epl|eclipse", "eclipse public", "epl", "epl(?:v?[0-9])?"),
    "cddl": ("cddl|common development", "common development and distribution", "cddl"),
    "bsd": ("bsd|berkeley", "(?:(?:[0-4] clause|two clause|three clause|new|revised|modified|simplified|original) )?(?:bsd(?: [0-4] clause)?|berkeley software distribution)", "bsd", "(?:[0-4] clause |new |simplified |modified )?bsd(?: [0-4] clause|[0-4]| style)?"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib"),
    "bsl": ("boost|bsl", "boost software", "bsl", "(?:bsl|boost)"),
    "artistic": ("artistic", "artistic", "artistic"),
    "psf": ("python|psf", "python(?: software foundation)?", "psf"),
    "ms-pl": ("microsoft public|ms pl", "microsoft public", "ms pl"),
    "ms-rl": ("microsoft reciprocal|ms rl", "microsoft reciprocal", "ms rl"),
    "ofl": ("open font|ofl", "(?:sil )?open font", "ofl", "(?:sil )?ofl"),
    "eupl": ("eupl|european union public", "european union public", "eupl"),
    "cecill": ("cecill", "cecill(?: [abc])?", "cecill", "cecill(?: [abc])?"),
    "afl": ("academic free|afl", "academic free", "afl"),
    "osl": ("open software|osl", "open software", "osl"),
    "ipl": ("ibm public|ipl", "ibm public", "ipl"),
    "cpl": ("common public|cpl", "common public", "cpl"),
    "apsl": ("apple public|apsl", "apple public source", "apsl"),
    "zpl": ("zope|zpl", "zope public", "zpl"),
    "php": ("php", "php", "php"),
    "ruby": ("ruby", "ruby", "ruby"),
    "openssl": ("openssl", "openssl", "openssl"),
    "vim": ("vim", "vim", "vim"),
    "w3c": ("w3c", "w3c(?: software(?: notice and)?)?", "w3c"),
    "x11": ("x11", "x11", "x11"),
    "curl": ("curl", "curl", "curl"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "ncsa": ("ncsa|university of illinois", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    "odbl": ("odbl|open database", "(?:odc )?open database", "odbl"),
    "upl": ("upl|universal permissive", "universal permissive", "upl"),
    "mulan": ("mulan", "mulan (?:permissive software|psl)", "mulan", "mulan(?: psl)?"),
    "sspl": ("sspl|server side public", "server side public", "sspl"),
    "busl": ("busl|business source", "business source", "busl"),
    "elastic": ("elastic", "elastic", "elastic"),
    "cc-by": ("cc by|creative commons", "creative commons attribution", "cc by"),
    "cc-by-sa": ("cc by sa|creative commons attribution share", "creative commons attribution share ?alike", "cc by sa"),
    "cc-by-nc": ("cc by nc|creative commons attribution non", "creative commons attribution non ?commercial", "cc by nc"),
    "cc-by-nd": ("cc by nd|creative commons attribution no", "creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"),
    "cc-by-nc-sa": ("cc by nc sa|creative commons attribution non", "creative commons attribution non ?commercial share ?alike", "cc by nc sa"),
    "cc-by-nc-nd": ("cc by nc nd|creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"),
    "cc0": ("cc0|creative commons zero", "(?:creative commons zero|cc0)(?: universal)?", "cc0"),
    "unlicense": ("unlicense", "the unlicense", "unlicense"),
    "wtfpl": ("wtfpl|do what the", "do what the fuck you want to public", "wtfpl"),
    "beerware": ("beer", "beer ?ware", "beerware", "beer ?ware"),
}
#: Its numbers are a possessive repeat, which Java's regex takes without recursion, however many there are.
NUMBERS = "[0-9]+(?: [0-9]+(?= ))*+(?: (?:international|unported|generic))?(?: (?:or|and)(?: any)? (?:later|newer)(?: versions?)?| only)?"
VERSION = "(?: (?:version |v ?)?" + NUMBERS + "| or later| only)?"
GRANT = "(?:licensed|released|distributed|published|available|provided|covered|governed|offered|redistributed) "
#: Families whose identifier also names a person, a program or a body: "provided by" one of them is no license without a version.
NAMES = (
    "mit", "apache", "isc", "zlib", "bsl", "artistic", "psf", "php", "ruby", "openssl", "vim", "w3c", "x11", "curl", "postgresql", "ncsa", "mulan", "elastic", "unlicense", "beerware",
)
ARTICLE = "(?:the |a |an )?(?:terms of |conditions of |terms and conditions of )?(?:the )?"
#: Forms of every family: (priority, confidence, words); {n}: the family's name, {i}: its identifier, {v}: a version; {by}: what leads to the identifier, {more}: another way to it.
FORMS = (
    (2, 0.97, "(?:spdx license identifier |" + GRANT + "{by} " + ARTICLE + "){i}{v}{more}"),
    (2, 0.97, GRANT + "(?:under|by|subject to) " + ARTICLE + "{n} licen[cs]e{v}"),
    (3, 0.9, "(?:under|see|subject to) " + ARTICLE + "{n} licen[cs]e{v}"),
    (4, 0.8, "{n} licen[cs]e{v}"),
    (5, 0.6, "(?:{i}{v} licen[cs]ed|licen[cs]e {i}{v})"),
)
PRIORITIES = 5
#: Every match of any rule has a word that starts like this, and one of the rules' keywords.
CUES = (
    "licen", "sublicen", "unlicen", "spdx", *(g + " " for g in "released distributed published available provided covered governed offered redistributed".split()),
    "permission", "redistribution", "software", "copyright", "public domain", "anyone is free", "png reference", "advertising", "copies of vim", "openssl", "font software", "php software",
    "org ", "net ", "joinup", "cecill", "same terms as perl", "rights reserved", "proprietary", "prohibited", "unauthori", "change date", "a beer", "you just do", "if a copy", "gnu ", "terms and",
)


def rules() -> list[dict]:
    """All rules in order: a pattern, a label, a priority, a confidence and keywords, one of which every match holds."""
    out = [(1, 1.0, label, keyword, words) for label, keyword, words in TEXTS] + [(2, 0.97, label, keyword, words) for label, keyword, words in NOTICES]
    for priority, confidence, words in FORMS:
        for label, (keyword, name, *short) in FAMILIES.items():
            by, more = "(?:under|by|subject to)", ""
            if label in NAMES:
                by, more = "(?:under|subject to)", "|" + GRANT + "by " + ARTICLE + short[-1] + " (?:version |v ?)" + NUMBERS
            out.append((priority, confidence, label, keyword, words.format(n=name, i=short[-1], v=VERSION, by=by, more=more)))
    return [
        {"id": k, "label": label, "gate": [" " + x for x in keyword.split("|")], "priority": p, "confidence": c, "pattern": f"(?<= )(?:{words})(?= )"}
        for k, (p, c, label, keyword, words) in enumerate(out)
    ]


KEPT = "array<struct<first:int,end:int,rule:int,label:string,confidence:double>>"


def spaces(c: Column) -> Column:
    """How many spaces a string has; in normalised text, its words' number less or more one."""
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def normalised(text: Column) -> Column:
    """A space, the lower-cased words with single spaces between, a space; " " without words."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATORS, " ")


def _holds(norm: Column, literals: list[str]) -> Column:
    """Whether a text has a word that starts like one of the literals: an expression that fails at once inside words."""
    return norm.rlike(" (?:" + "|".join(literals) + ")")


def _found(norm: str, gated: bool) -> Column:
    """The rules that match: structs of priority, rule, label, confidence, matches and pattern.

    Patterns are literals, so each is compiled once a task. The text is a lambda's argument,
    so that the rules are evaluated one by one instead of as one huge generated method.
    """

    def one(r: dict) -> str:
        gate = " OR ".join(f"contains(t, '{g}')" for g in r["gate"]) if gated else "true"
        return (
            f"CASE WHEN {gate} THEN named_struct('priority', {r['priority']}, 'rule', {r['id']}, 'label', '{r['label']}', 'confidence', "
            f"{r['confidence']}D, 'found', regexp_extract_all(t, '{r['pattern']}', 0), 'pattern', '{r['pattern']}') END"
        )

    return F.expr(f"transform(array(`{norm}`), t -> filter(array({', '.join(map(one, rules()))}), r -> size(r.found) > 0))")[0]


def _places(norm: Column, r: Column) -> Column:
    """A rule's matches as hits: structs of first word, minus end word, priority, rule, label, confidence."""
    pieces = F.split(norm, r["pattern"], -1)  # of rules that match only
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(r["found"])), r["found"], lambda b, m: F.struct(spaces(b).alias("gap"), spaces(m).alias("own")))
    passed = running(F.transform(pairs, lambda x: x["gap"] + x["own"]), lambda u, v: u + v)

    def hit(x: Column, before: Column) -> Column:
        first = before + x["gap"]
        return F.struct(
            (first - 1).alias("first"), (-(first + x["own"])).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"),
            r["label"].alias("label"), r["confidence"].alias("confidence"),
        )

    return F.zip_with(pairs, passed, hit)


def _unsuppressed(hits: Column) -> Column:
    """Of hits sorted by first word and longest first, those in no earlier one of as good a priority."""

    def kept(all_: Column) -> Column:
        ends = lambda p: F.transform(all_, lambda h: F.when(h["priority"] <= p, -h["minus_end"]).otherwise(-1))
        reach = [running(ends(p), lambda u, v: F.greatest(u, v), -1).alias(f"to{p}") for p in range(1, PRIORITIES + 1)]
        zipped = F.arrays_zip(all_.alias("h"), *reach)

        def free(z: Column) -> Column:
            to = F.lit(-1)
            for p in range(1, PRIORITIES + 1):
                to = F.when(z["h"]["priority"] == p, z[f"to{p}"]).otherwise(to)
            return to < -z["h"]["minus_end"]

        names = ("rule", "label", "confidence")
        return F.transform(
            F.filter(zipped, free),
            lambda z: F.struct(z["h"]["first"].alias("first"), (-z["h"]["minus_end"]).alias("end"), *(z["h"][n].alias(n) for n in names)),
        )

    return F.transform(F.array(F.array_sort(hits)), kept)[0]


def scan(docs: DataFrame, text: str = "text", gated: bool = True) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with ``norm`` (the normalised words) and ``detections`` (what the rules keep).

    A detection is struct<first, end, rule, label, confidence> in words, end exclusive, in
    order of place. Row by row and in the JVM: no shuffle. Null and empty texts and texts
    without keywords have no detections; repeated rows each keep their row. ``gated=False``
    runs every rule on every text, with the same result.
    """
    norm, found, present = fresh(docs, "norm"), fresh(docs, "detections"), fresh(docs, "present")
    out = docs.withColumn(norm, normalised(F.col(f"`{text}`")))
    n, none = F.col(norm), F.from_json(F.lit("[]"), KEPT)
    matches = _found(norm, gated)
    if gated:
        keywords = sorted({g for r in rules() for g in r["gate"]})
        matches = F.when(_holds(n, list(CUES)), F.when(_holds(n, [k[1:] for k in keywords]), matches))
    out = out.withColumn(present, matches)
    detections = F.when(F.size(present) > 0, _unsuppressed(F.flatten(F.transform(F.col(present), lambda r: _places(n, r))))).otherwise(none)
    return out.withColumn(found, detections).drop(present), (norm, found)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and a score of every document; null texts count as empty."""
    docs, (norm, found) = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col(norm)
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    has = n.contains(" license ")
    base = F.when(has, F.regexp_extract_all(n, F.lit(phrase), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.select("doc_id", n.alias("norm"), F.col(found).alias("found"), base.alias("base"))
    pieces = F.split("norm", phrase, -1)
    any_ = F.size("base") > 0
    labels = F.transform("base", lambda m: F.coalesce(*(F.when(m == k, v) for k, v in BASE.items())))
    docs = docs.select(
        "doc_id",
        F.greatest(spaces(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.when(any_, spaces(pieces[0]) - 1).cast("long").alias("first_word"),
        F.when(any_, spaces(F.col("norm")) - spaces(F.element_at(pieces, -1)) - spaces(F.element_at("base", -1)) - 1)
        .cast("long")
        .alias("last_word"),
        F.array_distinct(labels).alias("base_labels"),
        F.col("found"),
    )
    return docs.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.col("found.label"))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max("found.confidence"), F.lit(0.0)), F.when(F.size("base_labels") > 0, 0.8).otherwise(0.0)
        ).alias("score"),
        F.to_json("found").alias("detections"),
    )

