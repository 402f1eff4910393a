"""License scans: ordered signature rules over normalised words.

Hand-written regexes in levels of priority: identifiers, addresses, sentences of the texts themselves, grants, names and
general notices. One automaton of all rules' keywords tells which rules may match a text at all. Detections are resolved
in order of priority: one whose words lie inside a kept detection goes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import common

#: Phrases that every scan reports, with their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

# The rules, level by level: label, keywords (any of them, parted by |), regex over lower-case words between single blanks.

#: Tags that name a license for machines. Priority 0.
TAGS = (
    ("mit", "identifier mit", r"license identifier mit"),
    ("mit-0", "identifier mit 0", r"license identifier mit 0"),
    ("apache", "identifier apache", r"license identifier apache (?:1 0|1 1|2 0)"),
    ("agpl", "identifier agpl", r"license identifier agpl (?:1 0|3 0)(?: only| or later)?"),
    ("lgpl", "identifier lgpl", r"license identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("gpl", "identifier gpl", r"license identifier gpl (?:1 0|2 0|3 0)(?: only| or later)?"),
    ("bsd", "identifier bsd|identifier 0bsd", r"license identifier (?:0bsd|bsd [1234] clause)(?: patent| clear| lbnl)?"),
    ("mpl", "identifier mpl", r"license identifier mpl (?:1 0|1 1|2 0)"),
    ("epl", "identifier epl", r"license identifier epl (?:1 0|2 0)"),
    ("cddl", "identifier cddl", r"license identifier cddl 1 [01]"),
    ("isc", "identifier isc", r"license identifier isc"),
    ("zlib", "identifier zlib", r"license identifier zlib"),
    ("unlicense", "identifier unlicense", r"license identifier unlicense"),
    ("wtfpl", "identifier wtfpl", r"license identifier wtfpl"),
    ("cc0", "identifier cc0", r"license identifier cc0 1 0"),
    ("cc-by", "identifier cc by", r"license identifier cc by [1234] [05]"),
    ("cc-by-sa", "identifier cc by sa", r"license identifier cc by sa [1234] [05]"),
    ("cc-by-nd", "identifier cc by nd", r"license identifier cc by nd [1234] [05]"),
    ("cc-by-nc", "identifier cc by nc", r"license identifier cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "identifier cc by nc sa", r"license identifier cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "identifier cc by nc nd", r"license identifier cc by nc nd [1234] [05]"),
    ("artistic", "identifier artistic", r"license identifier artistic (?:1 0|2 0)(?: perl)?"),
    ("boost", "identifier bsl 1 0", r"license identifier bsl 1 0"),
    ("python", "identifier python|identifier psf", r"license identifier (?:python 2 0|psf 2 0)"),
    ("postgresql", "identifier postgresql", r"license identifier postgresql"),
    ("eupl", "identifier eupl", r"license identifier eupl 1 [12]"),
    ("ofl", "identifier ofl", r"license identifier ofl 1 [01]"),
    ("odbl", "identifier odbl", r"license identifier odbl 1 0"),
    ("osl", "identifier osl", r"license identifier osl [123] [01]"),
    ("ms-pl", "identifier ms pl", r"license identifier ms pl"),
    ("ms-rl", "identifier ms rl", r"license identifier ms rl"),
    ("upl", "identifier upl", r"license identifier upl 1 0"),
    ("vim", "identifier vim", r"license identifier vim"),
    ("openssl", "identifier openssl", r"license identifier openssl"),
    ("php", "identifier php", r"license identifier php 3 0(?:1)?"),
    ("ruby", "identifier ruby", r"license identifier ruby"),
    ("w3c", "identifier w3c", r"license identifier w3c(?: 1998[0-9]+| 2015[0-9]+)?"),
    ("sspl", "identifier sspl", r"license identifier sspl 1 0"),
    ("busl", "identifier busl", r"license identifier busl 1 1"),
    ("elastic", "identifier elastic", r"license identifier elastic 2 0"),
    ("ncsa", "identifier ncsa", r"license identifier ncsa"),
    ("proprietary", "identifier licenseref", r"license identifier licenseref (?:proprietary|commercial)"),
    ("gpl", "license gpl", r"license gpl (?:v)?[23](?: 0)?(?: or later)?"),
    ("mit", "license osi approved", r"license osi approved mit(?: no attribution)? license"),
    ("apache", "license osi approved", r"license osi approved apache software license"),
    ("bsd", "license osi approved", r"license osi approved bsd license"),
    ("gpl", "license osi approved", r"license osi approved gnu general public license(?: v[23] (?:or later )?g?pl\w*)?"),
    ("lgpl", "license osi approved", r"license osi approved gnu (?:lesser|library)(?: or (?:lesser|library))? general public license"),
    ("mpl", "license osi approved", r"license osi approved mozilla public license(?: [12] [01])?"),
    ("python", "license osi approved", r"license osi approved python software foundation license"),
)

#: Addresses of license texts. Priority 1.
ADDRESSES = (
    ("mit", "opensource org", r"opensource org licen[cs]es? mit(?: license)?(?: php)?"),
    ("bsd", "opensource org", r"opensource org licen[cs]es? bsd [23] clause"),
    ("bsd", "bsd license", r"opensource org licen[cs]es? bsd license(?: php)?"),
    ("isc", "opensource org", r"opensource org licen[cs]es? isc"),
    ("artistic", "opensource org", r"opensource org licen[cs]es? artistic license(?: [12] 0)?"),
    ("mpl", "opensource org", r"opensource org licen[cs]es? mpl [12] [01]"),
    ("epl", "opensource org", r"opensource org licen[cs]es? epl [12] 0"),
    ("zlib", "opensource org", r"opensource org licen[cs]es? zlib"),
    ("apache", "apache org", r"(?:www )?apache org licen[cs]es(?: license [12] [01])?(?: txt| html)?"),
    ("gpl", "gnu org", r"(?:www )?gnu org (?:licen[cs]es|copyleft) (?:old licenses )?gpl(?: [123] 0)?(?: en| standalone)?(?: html| txt)?"),
    ("lgpl", "gnu org", r"(?:www )?gnu org (?:licen[cs]es|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: [23] [01])?(?: en)?(?: html| txt)?"),
    ("agpl", "gnu org", r"(?:www )?gnu org licen[cs]es agpl(?: 3 0)?(?: en)?(?: html| txt)?"),
    ("gfdl", "gnu org", r"(?:www )?gnu org (?:licen[cs]es|copyleft) fdl(?: 1 [123])?(?: en)?(?: html| txt)?"),
    ("gpl", "gnu org", r"see (?:https? )?(?:www )?gnu org licenses"),
    ("mpl", "mozilla org", r"(?:www )?mozilla org (?:en us )?mpl(?: [12] [01])?(?: html| txt)?"),
    ("epl", "eclipse org", r"(?:www )?eclipse org (?:legal|org documents) epl (?:v10|v20|2 0|1 0)(?: html| txt)?"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org", r"creativecommons org licen[cs]es by [1234] [05]"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licen[cs]es by sa [1234] [05]"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licen[cs]es by nd [1234] [05]"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licen[cs]es by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licen[cs]es by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licen[cs]es by nc nd [1234] [05]"),
    ("boost", "boost org", r"(?:www )?boost org license 1 0(?: txt)?"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"(?:www )?wtfpl net"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("odbl", "opendatacommons org", r"opendatacommons org licen[cs]es odbl(?: 1 0)?"),
    ("pddl", "opendatacommons org", r"opendatacommons org licen[cs]es pddl(?: 1 0)?"),
    ("odc-by", "opendatacommons org", r"opendatacommons org licen[cs]es by(?: 1 0)?"),
    ("eupl", "eupl", r"joinup ec europa eu (?:\w+ ){1,6}eupl"),
    ("elastic", "elastic co", r"(?:www )?elastic co licensing elastic license"),
    ("sspl", "mongodb com", r"(?:www )?mongodb com licensing server side public license"),
    ("busl", "mariadb com", r"mariadb com bsl11"),
    ("postgresql", "postgresql org", r"(?:www )?postgresql org about licence"),
    ("php", "php net", r"(?:www )?php net license(?: 3 0[01])?(?: txt)?"),
    ("w3c", "w3 org", r"(?:www )?w3 org consortium legal (?:\w+ ){0,2}copyright software(?: and document)?"),
)

#: Sentences of the license texts. Priority 2.
SENTENCES = (
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "endorse or promote", r"neither the names? of (?:\w+ ){1,9}may be used to endorse or promote products derived from this software"),
    ("bsd", "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("apache", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", "licensed to the apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute it and or modify", r"(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify", r"(?:this library|this program|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute it and or modify", r"(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", "copy of the gnu lesser|copy of the gnu library", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "hope that it will be useful", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "copyleft license for software", r"the gnu general public license is a free copyleft license for software"),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("gfdl", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)?(?: [12] 0)?"),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("zlib", "without any express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what", r"you just do what the \w+ you want to"),
    ("boost", "boost software license", r"distributed under the boost software license version 1 0"),
    ("boost", "organization obtaining a copy", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "waived all copyright|public domain by waiving", r"(?:has|have) (?:dedicated the work to the public domain by waiving|waived all copyright and related or neighboring rights)"),
    ("cc-by", "must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "under the same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material"),
    ("ofl", "open font license", r"this font software is licensed under the sil open font license version 1 [01]"),
    ("ofl", "reserved font name", r"with reserved font names? \w+"),
    ("odbl", "open database license", r"this (?:\w+ )?database is made available under the open database license"),
    ("artistic", "package under the artistic", r"you may (?:use|modify|distribute)(?: \w+){0,6} this package under the artistic license"),
    ("python", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "includes php", r"this product includes php(?: software)? freely available from"),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source license"),
    ("eupl", "european commission|european union public", r"licensed under the eupl(?: version| v)?(?: 1 [12])? or as soon they will be approved by the european commission|licen[cs]ed under the european union public licence"),
    ("busl", "non production use", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"the commons clause license condition|commons clause restriction"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?(?: of \w+)?"),
    ("proprietary", "strictly prohibited", r"(?:unauthorized|unauthorised) (?:copying|use|reproduction|distribution)(?: \w+){0,8} is strictly prohibited"),
    ("proprietary", "no part of this", r"no part of this (?:work|publication|document|software) may be (?:reproduced|copied|distributed)"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
)

#: Grants: that something stands under a license. Priority 3.
_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|offered) under(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"
GRANTS = (
    ("mit", "mit", rf"{_GRANT} mit(?: x11| expat)?(?: license| licence)?"),
    ("apache", "apache", rf"{_GRANT} apache(?: software)?(?: license| licence)?(?: version| v)?(?: [12](?: [01])?| v2(?: 0)?)?"),
    ("gpl", "gpl|general public", rf"{_GRANT} (?:gnu )?(?:gpl|general public licen[cs]e)(?: ?version| ?v)?(?: ?[123](?: 0)?)?(?: or (?:any )?later(?: version)?)?"),
    ("lgpl", "lgpl|lesser|library general", rf"{_GRANT} (?:gnu )?(?:lgpl(?:v[23])?|(?:lesser|library) general public licen[cs]e)(?: version| v)?(?: [23](?: [01])?)?(?: or (?:any )?later(?: version)?)?"),
    ("agpl", "agpl|affero", rf"{_GRANT} (?:gnu )?(?:agpl(?:v3)?|affero general public licen[cs]e)(?: version| v)?(?: 3(?: 0)?)?(?: or (?:any )?later(?: version)?)?"),
    ("gfdl", "gfdl|free documentation", rf"{_GRANT} (?:gnu )?(?:gfdl|free documentation licen[cs]e)(?: version)?(?: 1 [123])?"),
    ("bsd", "bsd", rf"{_GRANT} (?:(?:new|simplified|modified|revised|[0234] clause) )*bsd(?: [0234] clause)?(?: style)?(?: license| licence)?"),
    ("mpl", "mpl|mozilla", rf"{_GRANT} (?:mpl|mozilla public licen[cs]e)(?: version| v)?(?: [12](?: [01])?)?"),
    ("epl", "epl|eclipse", rf"{_GRANT} (?:epl|eclipse public licen[cs]e)(?: version| v)?(?: [12](?: 0)?)?"),
    ("cddl", "cddl|common development", rf"{_GRANT} (?:cddl|common development and distribution licen[cs]e)(?: version)?(?: 1 [01])?"),
    ("isc", "isc", rf"{_GRANT} isc(?: license| licence)?"),
    ("zlib", "zlib", rf"{_GRANT} zlib(?: libpng)?(?: license| licence)?"),
    ("unlicense", "unlicense", rf"{_GRANT} unlicense"),
    ("wtfpl", "wtfpl", rf"{_GRANT} wtfpl"),
    ("cc0", "cc0|zero", rf"{_GRANT} (?:creative commons )?(?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc-by", "cc by|attribution", rf"{_GRANT} (?:creative commons )?(?:cc by|attribution)(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-sa", "by sa|alike", rf"{_GRANT} (?:creative commons )?(?:cc by sa|attribution share ?alike)(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-nd", "by nd|noderiv|no deriv", rf"{_GRANT} (?:creative commons )?(?:cc by nd|attribution no ?deriv\w*)(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-nc", "by nc|commercial", rf"{_GRANT} (?:creative commons )?(?:cc by nc|attribution non ?commercial)(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-nc-sa", "by nc sa|alike", rf"{_GRANT} (?:creative commons )?(?:cc by nc sa|attribution non ?commercial share ?alike)(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-nc-nd", "by nc nd|noderiv|no deriv", rf"{_GRANT} (?:creative commons )?(?:cc by nc nd|attribution non ?commercial no ?deriv\w*)(?: licen[cs]e)?(?: [1234] [05])?"),
    ("artistic", "artistic", rf"{_GRANT} (?:perl )?artistic licen[cs]e(?: [12] 0)?"),
    ("boost", "boost", rf"{_GRANT} boost(?: software)?(?: license| licence)?(?: 1 0)?"),
    ("python", "python", rf"{_GRANT} python(?: software foundation)? licen[cs]e"),
    ("postgresql", "postgresql", rf"{_GRANT} postgresql licen[cs]e"),
    ("eupl", "eupl", rf"{_GRANT} eupl(?: 1 [12])?"),
    ("ofl", "ofl|open font", rf"{_GRANT} (?:sil )?(?:ofl|open font licen[cs]e)(?: version)?(?: 1 [01])?"),
    ("odbl", "odbl|open database", rf"{_GRANT} (?:odbl|open database licen[cs]e)"),
    ("osl", "open software", rf"{_GRANT} open software licen[cs]e(?: version| v)?(?: [123](?: 0)?)?"),
    ("ms-pl", "microsoft public|ms pl", rf"{_GRANT} (?:microsoft public licen[cs]e|ms pl)"),
    ("ms-rl", "microsoft reciprocal|ms rl", rf"{_GRANT} (?:microsoft reciprocal licen[cs]e|ms rl)"),
    ("upl", "universal permissive|upl", rf"{_GRANT} (?:universal permissive licen[cs]e|upl)"),
    ("vim", "vim", rf"{_GRANT} vim licen[cs]e"),
    ("openssl", "openssl", rf"{_GRANT} openssl(?: license| licence)"),
    ("php", "php", rf"{_GRANT} php licen[cs]e"),
    ("ruby", "ruby", rf"{_GRANT} ruby licen[cs]e|{_GRANT} same terms as ruby"),
    ("perl", "perl", rf"{_GRANT} same terms as perl(?: itself)?"),
    ("w3c", "w3c", rf"{_GRANT} w3c(?: software)?(?: license| licence| notice)"),
    ("sspl", "sspl|server side", rf"{_GRANT} (?:sspl|server side public licen[cs]e)"),
    ("busl", "business source|busl", rf"{_GRANT} (?:busl|business source licen[cs]e)(?: 1 1)?"),
    ("elastic", "elastic", rf"{_GRANT} elastic licen[cs]e(?: 2 0)?"),
    ("proprietary", "proprietary|commercial", rf"{_GRANT} (?:proprietary|commercial) licen[cs]e"),
)

#: Names of licenses and of their versions. Priority 4.
NAMES = (
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e|licen[cs]e mit|mit licensed"),
    ("mit-0", "mit no attribution|mit 0", r"mit no attribution(?: license)?|mit 0"),
    ("apache", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version| v)?(?: [12](?: [01])?| v2)?|licen[cs]e apache(?: 2(?: 0)?)?|apache [12] 0"),
    ("gpl", "general public|gpl", r"(?:the )?(?:gnu )?general public licen[cs]e(?: version| v)?(?: [123](?: 0)?)?|gpl v?[123](?: 0)?|gplv[23]|gnu gpl"),
    ("lgpl", "lesser general|library general|lgpl", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)?(?: [23](?: [01])?)?|lgpl(?: v?[23](?: [01])?)?|lgplv[23]"),
    ("agpl", "affero|agpl", r"(?:the )?(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: 3(?: 0)?)?|agpl(?: v?3(?: 0)?)?|agplv3"),
    ("gfdl", "documentation licen", r"(?:the )?(?:gnu )?free documentation licen[cs]e(?: version)?(?: 1 [123])?"),
    ("bsd", "bsd", r"(?:(?:new|simplified|modified|revised) )?bsd(?: style)? licen[cs]e|bsd [0234] clause(?: licen[cs]e)?|(?:[0234]|two|three|four) clause bsd(?: licen[cs]e)?"),
    ("mpl", "mozilla public|mpl", r"mozilla public licen[cs]e(?: version| v)?(?: [12](?: [01])?)?|mpl v?[12](?: [01])?"),
    ("epl", "eclipse public|epl", r"eclipse public licen[cs]e(?: version| v)?(?: [12](?: 0)?)?|epl v?[12](?: 0)?"),
    ("cddl", "common development and|cddl", r"common development and distribution licen[cs]e|cddl(?: 1 [01])?"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "the unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl|do what the", r"wtfpl|do what the \w+ you want to public license"),
    ("cc0", "cc0|zero", r"cc0(?: 1 0)?(?: universal)?|creative commons zero"),
    ("cc-by", "cc by|attribution", r"creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?|cc by [1234] [05]"),
    ("cc-by-sa", "by sa|alike", r"(?:creative commons )?attribution share ?alike(?: [1234] [05])?|cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "by nd|deriv", r"(?:creative commons )?attribution no ?deriv\w*(?: [1234] [05])?|cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "by nc|commercial", r"(?:creative commons )?attribution non ?commercial(?: [1234] [05])?|cc by nc(?: [1234] [05])?"),
    ("cc-by-nc-sa", "by nc sa|alike", r"(?:creative commons )?attribution non ?commercial share ?alike(?: [1234] [05])?|cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "by nc nd|deriv", r"(?:creative commons )?attribution non ?commercial no ?deriv\w*(?: [1234] [05])?|cc by nc nd(?: [1234] [05])?"),
    ("artistic", "artistic licen", r"(?:the )?(?:perl )?artistic licen[cs]e(?: [12] 0)?"),
    ("boost", "boost software", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("python", "python software|psf licen", r"python software foundation licen[cs]e|psf licen[cs]e"),
    ("postgresql", "postgresql licen", r"(?:the )?postgresql licen[cs]e"),
    ("eupl", "european union public|eupl", r"european union public licen[cs]e|eupl(?: 1 [12])?"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: 1 [01])?"),
    ("odbl", "open database", r"open database licen[cs]e"),
    ("pddl", "public domain dedication and", r"public domain dedication and licen[cs]e"),
    ("osl", "open software licen", r"open software licen[cs]e(?: version| v)?(?: [123](?: 0)?)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e"),
    ("vim", "vim licen", r"(?:the )?vim licen[cs]e"),
    ("openssl", "openssl licen", r"(?:the )?openssl licen[cs]e"),
    ("php", "php licen", r"(?:the )?php licen[cs]e(?: version)?(?: 3 0[01])?"),
    ("ruby", "ruby licen", r"(?:the )?ruby licen[cs]e"),
    ("w3c", "w3c", r"w3c software (?:license|licence|notice)(?: and (?:license|licence|notice))?"),
    ("sspl", "server side public", r"server side public licen[cs]e"),
    ("busl", "business source", r"business source licen[cs]e(?: 1 1)?"),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2 0)?"),
    ("ncsa", "ncsa", r"ncsa open source licen[cs]e"),
    ("beerware", "beerware|beer ware", r"(?:the )?beer ?ware licen[cs]e"),
    ("json", "shall be used for good", r"the software shall be used for good not evil"),
    ("proprietary", "proprietary licen|commercial licen", r"(?:proprietary|commercial) licen[cs]e"),
)

#: Announcements of no license in particular. Priority 5.
NOTICES = (
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("permissive", "hereby granted free of charge", r"permission is hereby granted free of charge"),
    ("licensed", "free software", r"(?:this|the) (?:work|file|software|program|document|library|code) is free software"),
    ("licensed", "licensed|licenced", r"(?:this|the) (?:work|file|software|program|document|library|code) is licen[cs]ed"),
    ("licensed", "see the licen", r"see the licen[cs]e(?: file)? for (?:the )?(?:specific|details|more)"),
    ("public-domain", "public domain", r"(?:in the |into the )?public domain"),
)

LEVELS = ((TAGS, 1.0), (ADDRESSES, 0.98), (SENTENCES, 0.95), (GRANTS, 0.9), (NAMES, 0.8), (NOTICES, 0.5))


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]  # every match holds one of them
    regex: re.Pattern


def signatures() -> list[Signature]:
    """All rules in order: the base phrases first of all, then level by level."""
    out = [Signature(label, -1, 1.0, (phrase,), re.compile(rb"(?<= )" + phrase + rb"(?= )")) for phrase, label in BASE]
    for priority, (rules, confidence) in enumerate(LEVELS):
        for label, keywords, pattern in rules:
            out.append(Signature(label, priority, confidence, tuple(k.encode() for k in keywords.split("|")), re.compile(rf"(?<= )(?:{pattern})(?= )".encode())))
    return out


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def resolve(found: list[Detection]) -> list[Detection]:
    """Keeps detections in order of priority, length and place, but those inside one that is kept already.

    Of what is kept, the intervals that lie in no other stand in order, by starts and so by ends: the last one that starts
    no later than a detection tells whether any holds it.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        first, last = bisect_left(starts, d.start), bisect_right(ends, d.end)
        starts[first:last], ends[first:last] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


class Scanner:
    """The rules behind one automaton of all their keywords: a text is read once to tell which rules may match."""

    def __init__(self):
        import ahocorasick

        self.rules = signatures()
        self.of: dict[bytes, list[int]] = {}
        for j, r in enumerate(self.rules):
            for k in r.keywords:
                self.of.setdefault(k, []).append(j)
        self.gate = ahocorasick.Automaton()
        for k in self.of:
            self.gate.add_word(k.decode("latin-1"), k)
        self.gate.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[Detection]]:
        """Number of words, places (first word, label) of the base phrases, and the resolved detections."""
        words = common.plain_words(text)
        flat = b" " + b" ".join(words) + b" "
        present = {k for _, k in self.gate.iter(flat.decode("latin-1"))}
        if not present:
            return len(words), [], []
        before = _Places(flat)
        base = []
        for phrase, label in BASE:
            if phrase in present:
                wanted, at = b" " + phrase + b" ", -1
                while (at := flat.find(wanted, at + 1)) >= 0:
                    base.append((before.word(at + 1), label))
        found = []
        for j in sorted({j for k in present for j in self.of[k]}):
            rule = self.rules[j]
            for m in rule.regex.finditer(flat):
                start = before.word(m.start())
                found.append(Detection(start, start + m[0].count(b" ") + 1, rule.label, rule.priority, rule.confidence))
        return len(words), sorted(base), resolve(found)


class _Places:
    """Word numbers of byte places in a text of words between single blanks."""

    def __init__(self, flat: bytes):
        import numpy as np

        self.blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)

    def word(self, at: int) -> int:
        return int(self.blanks.searchsorted(at)) - 1


_workers: dict = {}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start:long,end:long,label:string,priority:int,confidence:double>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels, score and resolved detections (word intervals) of every document.

    A null text counts as empty: no words, no labels, score 0. The score is the highest confidence among detections.
    Repeated rows each give a row; a null doc_id stays null; other columns are ignored.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _workers.get("scanner") or _workers.setdefault("scanner", Scanner())
        for batch in common.sliced(batches):
            rows = []
            for doc_id, text in zip(common.column(batch, "doc_id"), common.texts(batch), strict=True):
                n, base, kept = scanner.scan(text)
                labels = {x for _, x in base}
                rows.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(base),
                    "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {d.label for d in kept})),
                    "score": max([1.0] * bool(base) + [d.confidence for d in kept], default=0.0),
                    "detections": [vars(d) for d in kept],
                })
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return common.id_and_text(docs).mapInArrow(make, SCHEMA)


_ARROW = pa.schema([
    *[(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")],
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())]))),
])


def licenses(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")
