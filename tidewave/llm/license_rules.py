"""Ordered signature rules of licenses: patterns over words, each with the word that has to be there.

A pattern is written over lower-case words with one space between them; words are runs of letters
and digits, so ``GPL-3.0-or-later`` reads ``gpl 3 0 or later``. It matches whole words only and has no
unbounded repeats over words. Rules of a higher level say more and win over the rules they
contain; within a level the earlier rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

TAG, GRANT, NAME, MENTION = 4, 3, 2, 1
# Confidence of a detection by the level of its rule.
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, NAME: 0.8, MENTION: 0.5}

V1, V2, V3 = (rf"(?:version |v )?v?{n}(?: 0)?" for n in (1, 2, 3))
GPL = r"(?:gnu )?(?:general public licen[cs]e|gpl)"
LGPL = r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)"
AGPL = r"(?:gnu )?(?:affero general public licen[cs]e|agpl)"
FDL = r"(?:gnu )?(?:free documentation licen[cs]e|fdl|gfdl)"
CC = r"(?:creative commons|cc)"
BY, NC, ND, SA = "(?:attribution|by)", "(?:noncommercial|non commercial|nc)", "(?:noderivatives|noderivs|no derivatives|nd)", "(?:sharealike|share alike|sa)"
INTERNATIONAL = r"(?: (?:international|unported|generic))?"
LICENCE = r"(?: public)?(?: licen[cs]e)?"
GIVEN = (r"(?:licen[cs]ed|released|distributed|redistributed|published|provided|available|shared|covered|dual licen[cs]ed) (?:for use )?"
         r"(?:under|by|through|according to) (?:an? |the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?")

# label, words of its identifier, pattern of its name, a word of every name
LICENSES = [
    ("0bsd", "0bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd|bsd 0 clause|free public)(?: licen[cs]e)?(?: 1 0 0)?", "bsd|free"),
    ("afl-3.0", "afl 3 0", rf"academic free licen[cs]e {V3}", "academic"),
    ("afl-2.1", "afl 2 1", r"academic free licen[cs]e (?:version |v )?v?2 1", "academic"),
    ("agpl-1.0", "agpl 1 0", rf"{AGPL} {V1}", "affero|agpl"),
    ("agpl-3.0", "agpl 3 0", rf"{AGPL} {V3}", "affero|agpl"),
    ("apache-1.0", "apache 1 0", rf"apache(?: software)? licen[cs]e {V1}", "apache"),
    ("apache-1.1", "apache 1 1", r"apache(?: software)? licen[cs]e (?:version |v )?v?1 1", "apache"),
    ("apache-2.0", "apache 2 0", rf"(?:apache(?: software)? licen[cs]e {V2}|apache {V2}(?: licen[cs]e)?|asl {V2})", "apache|asl"),
    ("apsl-2.0", "apsl 2 0", rf"apple public source licen[cs]e {V2}", "apple"),
    ("artistic-1.0", "artistic 1 0", rf"(?:perl )?artistic licen[cs]e {V1}", "artistic"),
    ("artistic-2.0", "artistic 2 0", rf"(?:perl )?artistic licen[cs]e {V2}", "artistic"),
    ("beerware", "beerware", r"(?:the )?beer ?ware licen[cs]e(?: revision 42)?", "beerware|beer"),
    ("blueoak-1.0.0", "blueoak 1 0 0", r"blue oak model licen[cs]e(?: 1 0 0)?", "oak"),
    ("bsd-1-clause", "bsd 1 clause", r"(?:one|1) clause bsd(?: licen[cs]e)?|bsd (?:one|1) clause(?: licen[cs]e)?", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:two|2) clause bsd(?: licen[cs]e)?|bsd (?:two|2) clause(?: licen[cs]e)?|(?:simplified|freebsd) bsd licen[cs]e|freebsd licen[cs]e", "bsd|freebsd"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:three|3) clause bsd(?: licen[cs]e)?|bsd (?:three|3) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:four|4) clause bsd(?: licen[cs]e)?|bsd (?:four|4) clause(?: licen[cs]e)?|(?:original|old) bsd licen[cs]e", "bsd"),
    ("bsl-1.0", "bsl 1 0", r"boost(?: software)? licen[cs]e(?: version)?(?: 1 0)?", "boost"),
    ("busl-1.1", "busl 1 1", r"business source licen[cs]e(?: version)?(?: 1 1)?", "business"),
    ("cc-by-1.0", "cc by 1 0", rf"{CC} {BY} 1 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-2.0", "cc by 2 0", rf"{CC} {BY} 2 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-2.5", "cc by 2 5", rf"{CC} {BY} 2 5{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-3.0", "cc by 3 0", rf"{CC} {BY} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-4.0", "cc by 4 0", rf"{CC} {BY} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-2.0", "cc by nc 2 0", rf"{CC} {BY} {NC} 2 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-3.0", "cc by nc 3 0", rf"{CC} {BY} {NC} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-4.0", "cc by nc 4 0", rf"{CC} {BY} {NC} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-nd-3.0", "cc by nc nd 3 0", rf"{CC} {BY} {NC} {ND} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", rf"{CC} {BY} {NC} {ND} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-sa-3.0", "cc by nc sa 3 0", rf"{CC} {BY} {NC} {SA} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", rf"{CC} {BY} {NC} {SA} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nd-3.0", "cc by nd 3 0", rf"{CC} {BY} {ND} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-nd-4.0", "cc by nd 4 0", rf"{CC} {BY} {ND} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-sa-2.0", "cc by sa 2 0", rf"{CC} {BY} {SA} 2 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-sa-3.0", "cc by sa 3 0", rf"{CC} {BY} {SA} 3 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc-by-sa-4.0", "cc by sa 4 0", rf"{CC} {BY} {SA} 4 0{INTERNATIONAL}{LICENCE}", "cc|creative"),
    ("cc0-1.0", "cc0 1 0", r"(?:creative commons zero|cc zero|cc0)(?: (?:version |v )?v?1 0)?(?: universal)?(?: public domain dedication)?", "cc0|zero"),
    ("cddl-1.0", "cddl 1 0", rf"common development and distribution licen[cs]e {V1}", "common"),
    ("cddl-1.1", "cddl 1 1", r"common development and distribution licen[cs]e (?:version |v )?v?1 1", "common"),
    ("cecill-2.1", "cecill 2 1", r"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: (?:version |v )?v?2 1)?", "cecill"),
    ("cecill-b", "cecill b", r"cecill b(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill"),
    ("cecill-c", "cecill c", r"cecill c(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill"),
    ("cpal-1.0", "cpal 1 0", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?", "common"),
    ("cpl-1.0", "cpl 1 0", r"common public licen[cs]e(?: version)?(?: 1 0)?", "common"),
    ("ecl-2.0", "ecl 2 0", rf"educational community licen[cs]e {V2}", "educational"),
    ("efl-2.0", "efl 2 0", rf"eiffel forum licen[cs]e {V2}", "eiffel"),
    ("elastic-2.0", "elastic 2 0", r"elastic licen[cs]e(?: (?:version |v )?v?2(?: 0)?)?", "elastic"),
    ("epl-1.0", "epl 1 0", rf"eclipse public licen[cs]e {V1}", "eclipse"),
    ("epl-2.0", "epl 2 0", rf"eclipse public licen[cs]e {V2}", "eclipse"),
    ("eupl-1.1", "eupl 1 1", r"european union public licen[cs]e (?:version |v )?v?1 1", "european"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[cs]e (?:version |v )?v?1 2", "european"),
    ("gfdl-1.1", "gfdl 1 1", rf"{FDL} (?:version |v )?v?1 1", "documentation|fdl|gfdl"),
    ("gfdl-1.2", "gfdl 1 2", rf"{FDL} (?:version |v )?v?1 2", "documentation|fdl|gfdl"),
    ("gfdl-1.3", "gfdl 1 3", rf"{FDL} (?:version |v )?v?1 3", "documentation|fdl|gfdl"),
    ("gpl-1.0", "gpl 1 0", rf"{GPL} {V1}", "general|gpl"),
    ("gpl-2.0", "gpl 2 0", rf"{GPL} {V2}", "general|gpl"),
    ("gpl-3.0", "gpl 3 0", rf"{GPL} {V3}", "general|gpl"),
    ("hpnd", "hpnd", r"historical permission notice and disclaimer", "historical"),
    ("ijg", "ijg", r"independent jpeg group licen[cs]e", "jpeg"),
    ("ipl-1.0", "ipl 1 0", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", "ibm"),
    ("isc", "isc", r"(?:isc|internet systems consortium) licen[cs]e", "isc|consortium"),
    ("lgpl-2.0", "lgpl 2 0", rf"{LGPL} {V2}", "lesser|library|lgpl"),
    ("lgpl-2.1", "lgpl 2 1", rf"{LGPL} (?:version |v )?v?2 1", "lesser|library|lgpl"),
    ("lgpl-3.0", "lgpl 3 0", rf"{LGPL} {V3}", "lesser|library|lgpl"),
    ("libpng-2.0", "libpng 2 0", r"(?:libpng|png)(?: reference library)? licen[cs]e(?: version 2)?", "libpng|png"),
    ("lppl-1.3c", "lppl 1 3c", r"latex project public licen[cs]e(?: (?:version |v )?v?1 3c?)?", "latex"),
    ("mit", "mit", r"(?:(?:expat|x11)(?: mit)?|mit(?: (?:x11|expat))?) licen[cs]e", "mit|expat|x11"),
    ("mit-0", "mit 0", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e", "mit"),
    ("mpl-1.0", "mpl 1 0", rf"(?:mozilla public licen[cs]e|mpl) {V1}", "mozilla|mpl"),
    ("mpl-1.1", "mpl 1 1", r"(?:mozilla public licen[cs]e|mpl) (?:version |v )?v?1 1", "mozilla|mpl"),
    ("mpl-2.0", "mpl 2 0", rf"(?:mozilla public licen[cs]e|mpl) {V2}", "mozilla|mpl"),
    ("ms-pl", "ms pl", r"(?:microsoft|ms) public licen[cs]e", "microsoft|ms"),
    ("ms-rl", "ms rl", r"(?:microsoft|ms) reciprocal licen[cs]e", "microsoft|ms"),
    ("mulanpsl-2.0", "mulanpsl 2 0", r"mulan(?: permissive software|psl)(?: licen[cs]e)?(?: v?2)?", "mulan"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("odbl-1.0", "odbl 1 0", r"(?:open data commons )?open database licen[cs]e(?: (?:version |v )?v?1 0)?|odbl", "database|odbl"),
    ("odc-by-1.0", "odc by 1 0", r"open data commons attribution licen[cs]e(?: (?:version |v )?v?1 0)?", "commons"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?v?1 1)?", "font"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("osl-3.0", "osl 3 0", rf"open software licen[cs]e {V3}", "open"),
    ("pddl-1.0", "pddl 1 0", r"(?:open data commons )?public domain dedication and licen[cs]e", "dedication"),
    ("php-3.01", "php 3 01", r"php licen[cs]e(?: (?:version |v )?v?3 0 ?1)?", "php"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("psf-2.0", "psf 2 0", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: (?:version |v )?v?2)?", "python|psf"),
    ("qpl-1.0", "qpl 1 0", r"q public licen[cs]e(?: (?:version |v )?v?1 0)?", "q"),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("sspl-1.0", "sspl 1 0", r"server side public licen[cs]e(?: (?:version |v )?v?1)?", "server"),
    ("unlicense", "unlicense", r"(?:the )?unlicen[cs]e", "unlicense|unlicence"),
    ("upl-1.0", "upl 1 0", r"universal permissive licen[cs]e(?: (?:version |v )?v?1 0)?", "universal"),
    ("vim", "vim", r"vim licen[cs]e", "vim"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", "w3c"),
    ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl|fuck"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("zpl-2.1", "zpl 2 1", r"zope public licen[cs]e(?: (?:version |v )?v?2 1)?", "zope"),
]

# label, pattern of a sentence of its text or of its address, a word of it
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[0-9a-z]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", "neither"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("gpl-2.0-or-later", "either version 2 (?:of the license )?or at your option any later version", "option"),
    ("gpl-3.0-or-later", "either version 3 (?:of the license )?or at your option any later version", "option"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", "redistribute"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "redistribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "domain"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "eclipse"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "permission"),
    ("cc", "this work is licen[cs]ed under a creative commons", "creative"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim"),
    ("proprietary", "all rights reserved(?: unauthorized copying| no part of)?", "reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized"),
    ("proprietary", "no part of this publication may be reproduced", "reproduced"),
    ("mit", "opensource org licenses mit(?: license)?(?: php| html)?", "opensource"),
    ("bsd", "opensource org licenses bsd [0-9a-z]+(?: clause)?", "opensource"),
    ("apache-2.0", "apache org licenses license 2 0(?: txt| html)?", "apache"),
    ("gpl-2.0", "gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?", "gnu"),
    ("gpl-3.0", "gnu org licenses gpl 3 0(?: txt| html)?", "gnu"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?", "gnu"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0(?: txt| html)?", "gnu"),
    ("agpl-3.0", "gnu org licenses agpl 3 0(?: txt| html)?", "gnu"),
    ("gpl", "gnu org licenses gpl(?: txt| html)?", "gnu"),
    ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0(?: txt)?", "mozilla"),
    ("epl-2.0", "eclipse org legal epl(?: v| 2 0| v2 0)?", "eclipse"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", "creativecommons"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", "creativecommons"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", "creativecommons"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", "creativecommons"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", "creativecommons"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0", "creativecommons"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", "creativecommons"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", "creativecommons"),
    ("unlicense", "unlicense org", "unlicense"),
]

# Names without a version or a clause: less is known, so longer rules contain them.
MENTIONS = [
    ("agpl", AGPL, "affero|agpl"),
    ("apache", r"apache(?: software)? licen[cs]e|asl", "apache|asl"),
    ("artistic", r"(?:perl )?artistic licen[cs]e", "artistic"),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("cc", r"creative commons(?: licen[cs]e)?", "creative"),
    ("cc-by", rf"{CC} {BY}", "cc|creative"),
    ("cc-by-nc", rf"{CC} {BY} {NC}", "cc|creative"),
    ("cc-by-nc-nd", rf"{CC} {BY} {NC} {ND}", "cc|creative"),
    ("cc-by-nc-sa", rf"{CC} {BY} {NC} {SA}", "cc|creative"),
    ("cc-by-nd", rf"{CC} {BY} {ND}", "cc|creative"),
    ("cc-by-sa", rf"{CC} {BY} {SA}", "cc|creative"),
    ("cddl", r"cddl|common development and distribution licen[cs]e", "cddl|common"),
    ("copyleft", r"copyleft(?: licen[cs]e)?", "copyleft"),
    ("epl", r"eclipse public licen[cs]e", "eclipse"),
    ("eupl", r"european union public licen[cs]e|eupl", "european|eupl"),
    ("gfdl", FDL, "documentation|fdl|gfdl"),
    ("gpl", GPL, "general|gpl"),
    ("lgpl", LGPL, "lesser|library|lgpl"),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla|mpl"),
    ("proprietary", r"proprietary licen[cs]e", "proprietary"),
    ("public-domain", r"public domain", "domain"),
    ("spdx", r"spdx licen[cs]e identifier", "spdx"),
]

# Fixed phrases: each place counts, whatever the rules make of it.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


@dataclass(frozen=True)
class Rule:
    """``keywords``: words of which one has to be in the text before the pattern is tried."""

    number: int
    label: str
    level: int
    pattern: str
    keywords: tuple[str, ...]


def ordered_rules() -> list[Rule]:
    """All rules, highest level first and in the order of the lists."""
    made = [(label, TAG, f"spdx licen[cs]e identifier {words}", "spdx") for label, words, _, _ in LICENSES]
    for tail, words in (("or-later", "or later"), ("only", "only")):
        made += [(f"{label}-{tail}", TAG, f"spdx licen[cs]e identifier {name} {words}", "spdx")
                 for label, name, _, _ in LICENSES if label.startswith(("gpl", "lgpl", "agpl", "gfdl"))]
    made += [(label, GRANT, f"{GIVEN}(?:{name})", key) for label, _, name, key in LICENSES]
    made += [(label, GRANT, pattern, key) for label, pattern, key in NOTICES]
    made += [(f"{label}-or-later", NAME, f"(?:{name}) or (?:at your option )?(?:any )?(?:later|newer|higher)(?: version)?", key)
             for label, _, name, key in LICENSES if label.startswith(("gpl", "lgpl", "agpl", "gfdl"))]
    made += [(label, NAME, f"(?:{name})", key) for label, _, name, key in LICENSES]
    made += [(label, MENTION, f"(?:{name})", key) for label, name, key in MENTIONS]
    return [Rule(n, label, level, pattern, tuple(keys.split("|"))) for n, (label, level, pattern, keys) in enumerate(made)]


RULES = ordered_rules()
