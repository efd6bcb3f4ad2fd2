"""Signature rules for licences, each written by hand.

A rule has a label, keywords with | between them, of which a text must hold one before its pattern is tried (every way
through the pattern contains one of them), and a pattern over lower-case text with single white space. The table it
stands in gives its priority (higher wins) and confidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Tags that name a licence beyond doubt.
TAGS = [
    ("mit", "spdx", r"spdx-license-identifier: ?\(?(?:mit-0|mit-modern-variant|mit|x11|expat)"),
    ("apache", "spdx", r"spdx-license-identifier: ?\(?apache-(?:1\.0|1\.1|2\.0)"),
    ("gpl", "spdx", r"spdx-license-identifier: ?\(?gpl-[123]\.0(?:-only|-or-later|\+)?"),
    ("lgpl", "spdx", r"spdx-license-identifier: ?\(?lgpl-(?:2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?"),
    ("agpl", "spdx", r"spdx-license-identifier: ?\(?agpl-(?:1\.0|3\.0)(?:-only|-or-later)?"),
    ("gfdl", "spdx", r"spdx-license-identifier: ?\(?gfdl-1\.[123](?:-only|-or-later)?"),
    ("bsd", "spdx", r"spdx-license-identifier: ?\(?(?:0bsd|bsd-[1234]-clause(?:-clear|-patent|-uc)?)"),
    ("isc", "spdx", r"spdx-license-identifier: ?\(?isc"),
    ("mpl", "spdx", r"spdx-license-identifier: ?\(?mpl-(?:1\.0|1\.1|2\.0)"),
    ("epl", "spdx", r"spdx-license-identifier: ?\(?epl-[12]\.0"),
    ("cddl", "spdx", r"spdx-license-identifier: ?\(?cddl-1\.[01]"),
    ("artistic", "spdx", r"spdx-license-identifier: ?\(?(?:clartistic|artistic-[12]\.0(?:-perl)?)"),
    ("zlib", "spdx", r"spdx-license-identifier: ?\(?(?:zlib-acknowledgement|zlib|libpng)"),
    ("boost", "spdx", r"spdx-license-identifier: ?\(?bsl-1\.0"),
    ("unlicense", "spdx", r"spdx-license-identifier: ?\(?unlicense"),
    ("wtfpl", "spdx", r"spdx-license-identifier: ?\(?wtfpl"),
    ("cc0", "spdx", r"spdx-license-identifier: ?\(?cc0-1\.0"),
    ("cc-by-nc-sa", "spdx", r"spdx-license-identifier: ?\(?cc-by-nc-sa-[1234]\.\d"),
    ("cc-by-nc-nd", "spdx", r"spdx-license-identifier: ?\(?cc-by-nc-nd-[1234]\.\d"),
    ("cc-by-nc", "spdx", r"spdx-license-identifier: ?\(?cc-by-nc-[1234]\.\d"),
    ("cc-by-sa", "spdx", r"spdx-license-identifier: ?\(?cc-by-sa-[1234]\.\d"),
    ("cc-by-nd", "spdx", r"spdx-license-identifier: ?\(?cc-by-nd-[1234]\.\d"),
    ("cc-by", "spdx", r"spdx-license-identifier: ?\(?cc-by-[1234]\.\d"),
    ("eupl", "spdx", r"spdx-license-identifier: ?\(?eupl-1\.[012]"),
    ("ofl", "spdx", r"spdx-license-identifier: ?\(?ofl-1\.[01]"),
    ("psf", "spdx", r"spdx-license-identifier: ?\(?(?:psf-2\.0|python-2\.0)"),
    ("postgresql", "spdx", r"spdx-license-identifier: ?\(?postgresql"),
    ("openssl", "spdx", r"spdx-license-identifier: ?\(?openssl"),
    ("ms-pl", "spdx", r"spdx-license-identifier: ?\(?ms-pl"),
    ("ms-rl", "spdx", r"spdx-license-identifier: ?\(?ms-rl"),
    ("odbl", "spdx", r"spdx-license-identifier: ?\(?odbl-1\.0"),
    ("pddl", "spdx", r"spdx-license-identifier: ?\(?pddl-1\.0"),
    ("upl", "spdx", r"spdx-license-identifier: ?\(?upl-1\.0"),
    ("ncsa", "spdx", r"spdx-license-identifier: ?\(?ncsa"),
    ("mulan", "spdx", r"spdx-license-identifier: ?\(?mulanpsl-[12]\.0"),
    ("sspl", "spdx", r"spdx-license-identifier: ?\(?sspl-1\.0"),
    ("elastic", "spdx", r"spdx-license-identifier: ?\(?elastic-2\.0"),
    ("busl", "spdx", r"spdx-license-identifier: ?\(?busl-1\.1"),
    ("cecill", "spdx", r"spdx-license-identifier: ?\(?cecill-(?:1\.1|2\.0|2\.1|b|c)"),
    ("proprietary", "spdx", r"spdx-license-identifier: ?\(?licenseref-(?:scancode-)?proprietary"),
]
#: Sentences of a licence's own text or of the notice that it asks for.
SENTENCES = [
    ("mit", "hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "deal in the", r"to deal in the software without restriction, including without limitation the rights"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"merchantability, fitness for a particular purpose and noninfringement\. in no event shall the authors or copyright holders"),
    ("mit", "except as contained", r"except as contained in this notice, the names? of .{1,60} shall not be used in advertising"),
    ("isc", "with or without fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse or promote", r"neither the names? of .{1,80} may be used to endorse or promote products derived from this software"),
    ("bsd", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "regents", r"the regents of the university of california\. all rights reserved"),
    ("apache", "unless required", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e is distributed on an \"as is\" basis"),
    ("apache", "except in compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "contributor license", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", "perpetual, worldwide", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright licen[sc]e"),
    ("apache", "terms and conditions for use", r"terms and conditions for use, reproduction, and distribution"),
    ("gpl", "this program is free", r"this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public"),
    ("gpl", "published by the free", r"gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[sc]e along with"),
    ("gpl", "see the gnu general", r"fitness for a particular purpose\. see the gnu general public licen[sc]e for more details"),
    ("gpl", "absolutely no warranty", r"this program comes with absolutely no warranty"),
    ("gpl", "freedom to share", r"intended to guarantee your freedom to share and change (?:free software|all versions of a program)"),
    ("gpl", "at your option", r"version [23] of the licen[sc]e,? or \(at your option\) any later version"),
    ("gpl", "classpath exception", r"classpath exception as provided|with the classpath exception"),
    ("gpl", "linking exception|special exception|runtime library exception", r"gcc runtime library exception|as a special exception, .{1,120} linking|linking exception"),
    ("lgpl", "this library is free", r"this library is free software[:;,] you can redistribute it and/or modify it"),
    ("lgpl", "lesser general public|library general public", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "received a copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[sc]e"),
    ("agpl", "remotely through", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("gfdl", "free documentation", r"copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under"),
    ("cddl", "common development and", r"the contents of this file are subject to the terms of (?:either .{1,80} or )?the common development and distribution licen[sc]e"),
    ("artistic", "standard version", r"you may make and give away verbatim copies of the source form of the standard version"),
    ("artistic", "same terms as perl", r"you can redistribute it and/or modify it under the same terms as perl itself|under the same terms as perl itself"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", "boost software", r"distributed under the boost software licen[sc]e"),
    ("boost", "machine-executable", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("public-domain", "public domain", r"(?:has been |is )?(?:released|placed|dedicated|put)(?: in)?to the public domain|placed in the public domain"),
    ("public-domain", "public domain", r"(?:this (?:work|software|file|code) is|is hereby) in the public domain"),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "no copyright|no known copyright", r"no copyright is claimed|no known copyright restrictions|no copyright restrictions apply"),
    ("wtfpl", "you just do", r"you just do what the \w{4} you want to"),
    ("wtfpl", "copy and distribute verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document, and changing it is allowed"),
    ("beerware", "beer in return", r"you can buy me a beer in return"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"to the extent possible under law, .{1,120} cc0"),
    ("cc-by", "attribution 4.0 international|attribution 3.0 unported", r"licensed under (?:a|the) creative commons (?:attribution 4\.0 international|attribution 3\.0 unported)"),
    ("ofl", "reserved font name", r"with reserved font names?"),
    ("ofl", "open font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("psf", "python software foundation", r"licen[sc]e agreement is between the python software foundation"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "php", r"this product includes php(?: software)?, freely available from"),
    ("w3c", "world wide web consortium", r"copyright .{1,60} world wide web consortium"),
    ("curl", "daniel stenberg", r"copyright .{1,60} daniel stenberg"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright .{1,80} the freetype project"),
    ("json", "good, not evil", r"the software shall be used for good, not evil"),
    ("sspl", "functionality of the program", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl", "change date", r"effective on the change date|change date, or the fourth anniversary"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)? condition"),
    ("llama", "community license agreement|meta platforms", r"llama \d(?:\.\d)? community license agreement|llama materials .{1,60} meta platforms"),
    ("openrail", "use-based restrictions", r"use-based restrictions (?:set forth|as referenced) in (?:paragraph|attachment)"),
    ("proprietary", "rights reserved", r"all rights reserved\.? (?:unauthori[sz]ed|no part of)"),
    ("proprietary", "proprietary and confidential|confidential and proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "written permission", r"without the (?:prior )?(?:express )?(?:prior )?written permission of"),
    ("proprietary", "end user licen|end-user licen", r"end[ -]user licen[sc]e agreement"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?:, distributed| or transmitted| in any form)"),
    ("proprietary", "trade secret", r"contains (?:valuable )?trade secrets"),
    ("proprietary", "evaluation purposes", r"for evaluation purposes only"),
    ("non-commercial", "non-commercial|noncommercial|non commercial", r"for (?:non-commercial|noncommercial|non commercial)(?: use| purposes|, educational)(?: only)?"),
    ("non-commercial", "research purposes only|academic use only", r"for research purposes only|for academic use only"),
    ("no-ai", "text and data mining", r"(?:reserves|reserved|opts? out of)(?: the)?(?: rights?)?(?: for| to| of)? text and data mining"),
]
#: Metadata fields and headers with a licence's short name.
FIELDS = [
    ("mit", "mit|x11|expat", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:mit-0|mit|x11|expat)"),
    ("apache", "apache|asl 2", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:apache(?:-| |, version )?(?:licen[sc]e )?(?:v\.? ?)?[12](?:\.\d)?|apache|asl 2\.0)"),
    ("gpl", "gpl|general public", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:gnu )?(?:gplv?-?[123]?(?:\.\d)?(?:-only|-or-later|\+)?|general public licen[sc]e)"),
    ("lgpl", "lgpl|lesser general", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:gnu )?(?:lgplv?-?[23]?(?:\.\d)?(?:-only|-or-later|\+)?|lesser general public licen[sc]e)"),
    ("agpl", "agpl|affero", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:gnu )?(?:agplv?-?3?(?:\.0)?(?:-only|-or-later|\+)?|affero general public licen[sc]e)"),
    ("gfdl", "gfdl", r"licen[sc]e[\"']? ?[:=] ?[\"']?gfdl(?:-1\.\d)?"),
    ("bsd", "bsd", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:0bsd|(?:new |modified |simplified |\d-clause )?bsd(?:-\d-clause)?)"),
    ("isc", "isc", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?isc"),
    ("mpl", "mpl|mozilla", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:mpl(?:-| )?[12]\.\d|mozilla public)"),
    ("epl", "epl|eclipse", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:epl(?:-| )?[12]\.0|eclipse public)"),
    ("cddl", "cddl", r"licen[sc]e[\"']? ?[:=] ?[\"']?cddl(?:-1\.\d)?"),
    ("artistic", "artistic|perl", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?(?:artistic(?:-[12]\.0)?|perl(?:_5)?)"),
    ("zlib", "zlib|libpng", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:zlib|libpng)"),
    ("boost", "bsl-1|boost", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:bsl-1\.0|boost)"),
    ("unlicense", "unlicense", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"licen[sc]e[\"']? ?[:=] ?[\"']?wtfpl"),
    ("cc0", "cc0", r"licen[sc]e[\"']? ?[:=] ?[\"']?cc0(?:[- ]1\.0)?"),
    ("cc-by-nc-sa", "cc-by-nc-sa|cc by-nc-sa|cc by nc sa", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by-nc-sa|cc by-nc-sa|cc by nc sa)(?:[- ]\d\.\d)?"),
    ("cc-by-nc-nd", "cc-by-nc-nd|cc by-nc-nd|cc by nc nd", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by-nc-nd|cc by-nc-nd|cc by nc nd)(?:[- ]\d\.\d)?"),
    ("cc-by-nc", "cc-by-nc|cc by-nc|cc by nc", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by-nc|cc by-nc|cc by nc)(?![- ][sn][ad])(?:[- ]\d\.\d)?"),
    ("cc-by-sa", "cc-by-sa|cc by-sa|cc by sa", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by-sa|cc by-sa|cc by sa)(?:[- ]\d\.\d)?"),
    ("cc-by-nd", "cc-by-nd|cc by-nd|cc by nd", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by-nd|cc by-nd|cc by nd)(?:[- ]\d\.\d)?"),
    ("cc-by", "cc-by|cc by", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:cc-by|cc by)(?![- ](?:sa|nc|nd))(?:[- ]\d\.\d)?"),
    ("eupl", "eupl", r"licen[sc]e[\"']? ?[:=] ?[\"']?eupl(?:-1\.\d)?"),
    ("ofl", "ofl", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:sil )?ofl(?:-1\.\d)?"),
    ("psf", "psf|python-2|python software", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:psf(?:-2\.0)?|python-2\.0|python software foundation)"),
    ("php", "php", r"licen[sc]e[\"']? ?[:=] ?[\"']?php(?:-3\.\d+)?"),
    ("ruby", "ruby", r"licen[sc]e[\"']? ?[:=] ?[\"']?ruby"),
    ("postgresql", "postgresql", r"licen[sc]e[\"']? ?[:=] ?[\"']?postgresql"),
    ("ms-pl", "ms-pl", r"licen[sc]e[\"']? ?[:=] ?[\"']?ms-pl"),
    ("ms-rl", "ms-rl", r"licen[sc]e[\"']? ?[:=] ?[\"']?ms-rl"),
    ("odbl", "odbl", r"licen[sc]e[\"']? ?[:=] ?[\"']?odbl"),
    ("sspl", "sspl", r"licen[sc]e[\"']? ?[:=] ?[\"']?sspl"),
    ("busl", "busl", r"licen[sc]e[\"']? ?[:=] ?[\"']?busl"),
    ("ncsa", "ncsa", r"licen[sc]e[\"']? ?[:=] ?[\"']?ncsa"),
    ("public-domain", "public domain|public-domain", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:public domain|public-domain)"),
    ("proprietary", "proprietary|unlicensed|commercial", r"licen[sc]e[\"']? ?[:=] ?[\"']?(?:proprietary|unlicensed|commercial)"),
    ("mit", "osi approved", r"licen[sc]e :: osi approved :: mit"),
    ("apache", "osi approved", r"licen[sc]e :: osi approved :: apache"),
    ("bsd", "osi approved", r"licen[sc]e :: osi approved :: bsd"),
    ("gpl", "osi approved", r"licen[sc]e :: osi approved :: gnu general public"),
    ("lgpl", "osi approved", r"licen[sc]e :: osi approved :: gnu (?:lesser|library)"),
    ("mpl", "osi approved", r"licen[sc]e :: osi approved :: mozilla"),
    ("isc", "osi approved", r"licen[sc]e :: osi approved :: isc"),
    ("psf", "osi approved", r"licen[sc]e :: osi approved :: python software"),
    ("gpl", "module_license", r"module_license ?\( ?\"(?:dual .{1,12}/)?gpl(?: v2)?\" ?\)"),
]
#: Grants that name the licence.
GRANTS = [
    ("mit", "mit licen|expat licen", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the |an? )?(?:mit licen[sc]e|expat licen[sc]e)"),
    ("apache", "apache", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the |an? )?apache(?: software)? licen[sc]e(?:,? version| v\.?)? ?[12]?(?:\.\d)?"),
    ("gpl", "general public", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:gnu )?general public licen[sc]e(?:,? version| v\.?)? ?[123]?"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:gnu )?gpl(?: ?v\.? ?[123]| version [123])?"),
    ("lgpl", "lesser general|library general", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e(?:,? version| v\.?)? ?[23]?(?:\.\d)?"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:gnu )?lgpl(?: ?v\.? ?[23](?:\.\d)?)?"),
    ("agpl", "affero", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e(?:,? version| v\.?)? ?3?"),
    ("agpl", "agpl", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:gnu )?agpl(?: ?v\.? ?3)?"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the |an? )?(?:new |modified |revised |simplified |original )?(?:[234]-clause )?bsd(?:-style)?(?: [234]-clause)? licen[sc]e"),
    ("isc", "isc", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?isc licen[sc]e"),
    ("mpl", "mozilla public", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?mozilla public licen[sc]e(?:,? version| v\.?)? ?[12]?(?:\.\d)?"),
    ("epl", "eclipse public", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?eclipse public licen[sc]e(?:,? version| - v| v\.?)? ?[12]?(?:\.\d)?"),
    ("cddl", "cddl|development and distribution", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:cddl|common development and distribution licen[sc]e)"),
    ("artistic", "artistic", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?artistic licen[sc]e(?: 2\.0)?"),
    ("zlib", "zlib", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?zlib(?:/libpng)? licen[sc]e"),
    ("unlicense", "unlicense", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?wtfpl"),
    ("cc0", "cc0", r"(?:licensed|released|distributed|available|provided|published|dedicated) under (?:the terms of )?(?:the )?(?:creative commons )?cc0"),
    ("cc-by-sa", "cc by-sa|cc-by-sa", r"(?:licensed|released|distributed|available|provided|published) under (?:an? )?(?:cc by-sa|cc-by-sa)(?:[- ]\d\.\d)?"),
    ("cc-by-nc", "cc by-nc|cc-by-nc", r"(?:licensed|released|distributed|available|provided|published) under (?:an? )?(?:cc by-nc|cc-by-nc)(?!-)(?: \d\.\d)?"),
    ("cc-by", "cc by|cc-by", r"(?:licensed|released|distributed|available|provided|published) under (?:an? )?(?:cc by|cc-by)(?!-)(?: \d\.\d)?"),
    ("eupl", "european union public|eupl", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:european union public licen[sc]e|eupl)(?: v\.?)? ?1?(?:\.\d)?"),
    ("ofl", "open font", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?(?:sil )?open font licen[sc]e"),
    ("odbl", "open database", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?open database licen[sc]e"),
    ("sspl", "server side public", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?server side public licen[sc]e"),
    ("busl", "business source", r"(?:licensed|released|distributed|available|provided|published) under (?:the terms of )?(?:the )?business source licen[sc]e"),
    ("public-domain", "public domain", r"(?:dedicated|released|donated|contributed) to the public domain"),
    ("gpl", "gpl|general public", r"dual[- ]licensed under .{1,40} (?:gpl|general public licen[sc]e)"),
    ("mit", "mit", r"dual[- ]licensed under (?:the )?mit"),
    ("apache", "apache", r"dual[- ]licensed under .{1,40} apache"),
]
#: Versions and "or later" clauses.
VERSIONS = [
    ("apache", "apache", r"apache(?: software)? licen[sc]e,? (?:version|v\.?) ?[12]\.\d"),
    ("apache", "apache", r"apache[- ]2(?:\.0)?"),
    ("gpl", "general public", r"general public licen[sc]e,? (?:version|v\.?) ?[123](?:\.0)?(?:,? or (?:\(at your option\) )?(?:any )?later(?: version)?)?"),
    ("gpl", "gpl", r"gpl ?v\.? ?[123](?:\.0)?(?:\+| or later| or any later version)?"),
    ("gpl", "gpl", r"gpl-?[23](?:\.0)?\+"),
    ("lgpl", "lesser general|library general", r"(?:lesser|library) general public licen[sc]e,? (?:version|v\.?) ?[23](?:\.\d)?(?:,? or (?:\(at your option\) )?(?:any )?later(?: version)?)?"),
    ("lgpl", "lgpl", r"lgpl ?v\.? ?[23](?:\.\d)?(?:\+| or later)?"),
    ("agpl", "affero", r"affero general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?(?:,? or (?:any )?later)?"),
    ("agpl", "agpl", r"agpl ?v\.? ?3(?:\+| or later)?"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e,? (?:version|v\.?) ?[12]\.\d"),
    ("mpl", "mpl", r"mpl[- ]?(?:v\.? ?)?[12]\.\d"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e,? (?:- )?(?:version|v\.?) ?[12]\.\d"),
    ("cddl", "cddl", r"cddl[- ](?:v\.?)?1\.\d"),
    ("artistic", "artistic", r"artistic licen[sc]e,? (?:version |v\.? ?)?[12]\.\d"),
    ("gfdl", "free documentation", r"free documentation licen[sc]e,? (?:version|v\.?) ?1\.\d"),
    ("boost", "boost software", r"boost software licen[sc]e,? -? ?(?:version|v\.?) ?1\.0"),
    ("cc0", "cc0", r"cc0 1\.0(?: universal)?"),
    ("cc-by-nc-sa", "cc by-nc-sa|cc-by-nc-sa", r"(?:cc by-nc-sa|cc-by-nc-sa)[- ]\d\.\d"),
    ("cc-by-nc-nd", "cc by-nc-nd|cc-by-nc-nd", r"(?:cc by-nc-nd|cc-by-nc-nd)[- ]\d\.\d"),
    ("cc-by-nc", "cc by-nc|cc-by-nc", r"(?:cc by-nc|cc-by-nc)[- ]\d\.\d"),
    ("cc-by-sa", "cc by-sa|cc-by-sa", r"(?:cc by-sa|cc-by-sa)[- ]\d\.\d"),
    ("cc-by-nd", "cc by-nd|cc-by-nd", r"(?:cc by-nd|cc-by-nd)[- ]\d\.\d"),
    ("cc-by", "cc by|cc-by", r"(?:cc by|cc-by)[- ]\d\.\d"),
    ("eupl", "eupl", r"eupl[- ]?v?\.? ?1\.\d"),
    ("osl", "open software licen", r"open software licen[sc]e,? (?:version |v\.? ?)?[123]\.\d"),
    ("afl", "academic free licen", r"academic free licen[sc]e,? (?:version |v\.? ?)?[123]\.\d"),
    ("ofl", "open font", r"open font licen[sc]e,? (?:version |v\.? ?)?1\.[01]"),
    ("php", "php licen", r"php licen[sc]e,? (?:version |v\.? ?)3\.\d+"),
    ("bsd", "clause bsd", r"[1234][- ]clause bsd"),
    ("bsd", "bsd", r"bsd[- ][1234][- ]clause"),
]
#: Addresses of licence texts.
ADDRESSES = [
    ("mit", "opensource.org/licenses/mit|mit-license.org", r"opensource\.org/licenses/mit|mit-license\.org"),
    ("apache", "apache.org/licenses", r"apache\.org/licenses/"),
    ("apache", "opensource.org/licenses/apache", r"opensource\.org/licenses/apache"),
    ("gpl", "gnu.org/licenses/gpl|gnu.org/licenses/old-licenses/gpl|gnu.org/copyleft/gpl", r"gnu\.org/(?:licenses/gpl|licenses/old-licenses/gpl|copyleft/gpl)"),
    ("gpl", "opensource.org/licenses/gpl", r"opensource\.org/licenses/gpl"),
    ("lgpl", "gnu.org/licenses/lgpl|gnu.org/licenses/old-licenses/lgpl|gnu.org/copyleft/lesser", r"gnu\.org/(?:licenses/lgpl|licenses/old-licenses/lgpl|copyleft/lesser)"),
    ("agpl", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gnu.org/licenses/fdl|gnu.org/copyleft/fdl", r"gnu\.org/(?:licenses/fdl|copyleft/fdl)"),
    ("bsd", "opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd"),
    ("isc", "opensource.org/licenses/isc", r"opensource\.org/licenses/isc"),
    ("mpl", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse.org", r"eclipse\.org/(?:legal/epl|org/documents/epl)"),
    ("cddl", "opensource.org/licenses/cddl", r"opensource\.org/licenses/cddl"),
    ("artistic", "perlfoundation.org/artistic|opensource.org/licenses/artistic", r"perlfoundation\.org/artistic|opensource\.org/licenses/artistic"),
    ("zlib", "zlib.net/zlib_license", r"zlib\.net/zlib_license"),
    ("boost", "boost.org", r"boost\.org/license_"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("cc0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", "licenses/by/", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("eupl", "joinup.ec.europa.eu", r"joinup\.ec\.europa\.eu/\S{0,60}eupl"),
    ("ofl", "scripts.sil.org/ofl|openfontlicense.org", r"scripts\.sil\.org/ofl|openfontlicense\.org"),
    ("psf", "python.org/psf", r"python\.org/psf/license"),
    ("php", "php.net/license", r"php\.net/license"),
    ("odbl", "opendatacommons.org/licenses/odbl", r"opendatacommons\.org/licenses/odbl"),
    ("pddl", "opendatacommons.org/licenses/pddl", r"opendatacommons\.org/licenses/pddl"),
    ("sspl", "mongodb.com/licensing", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic", "elastic.co/licensing", r"elastic\.co/licensing/elastic-license"),
    ("busl", "mariadb.com/bsl", r"mariadb\.com/bsl"),
    ("polyform", "polyformproject.org", r"polyformproject\.org/licenses"),
    ("mulan", "license.coscl.org.cn", r"license\.coscl\.org\.cn/mulanpsl"),
    ("cecill", "cecill.info", r"cecill\.info"),
    ("llama", "llama.meta.com|ai.meta.com/llama", r"llama\.meta\.com/\S{0,30}license|ai\.meta\.com/llama/license"),
    ("openrail", "licenses.ai", r"licenses\.ai"),
]
#: Bare names.
NAMES = [
    ("mit", "mit licen|expat licen", r"(?:the )?(?:mit licen[sc]e|expat licen[sc]e)"),
    ("apache", "apache", r"(?:the )?apache(?: software)? licen[sc]e"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("lgpl", "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", "gnu lgpl", r"gnu lgpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |revised |simplified |original |berkeley )?bsd(?:-style| style)? licen[sc]e"),
    ("isc", "isc licen", r"(?:the )?isc licen[sc]e"),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[sc]e"),
    ("epl", "eclipse", r"(?:the )?eclipse public licen[sc]e"),
    ("cddl", "development and distribution", r"common development and distribution licen[sc]e"),
    ("cpl", "common public", r"(?<!gnu )common public licen[sc]e"),
    ("artistic", "artistic", r"(?:the )?artistic licen[sc]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)? licen[sc]e"),
    ("boost", "boost", r"(?:the )?boost software licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want to", r"do what the \w{4} you want to public licen[sc]e"),
    ("cc0", "creative commons zero", r"creative commons zero"),
    ("cc-by", "attribution", r"creative commons attribution(?!-| share| non| no)"),
    ("cc-by-sa", "attribution", r"creative commons attribution[- ]share ?-?alike"),
    ("cc-by-nc", "attribution", r"creative commons attribution[- ]non ?-?commercial(?![- ](?:share|no))"),
    ("cc-by-nd", "attribution", r"creative commons attribution[- ]no ?-?deriv(?:ative|ative works|atives|s)"),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution[- ]non ?-?commercial[- ]share ?-?alike"),
    ("cc-by-nc-nd", "attribution", r"creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:ative|ative works|atives|s)"),
    ("eupl", "european union public", r"european union public licen[sc]e"),
    ("osl", "open software licen", r"open software licen[sc]e"),
    ("afl", "academic free", r"academic free licen[sc]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e"),
    ("psf", "python software foundation", r"python software foundation licen[sc]e"),
    ("php", "php licen", r"(?:the )?php licen[sc]e"),
    ("ruby", "ruby licen", r"(?:the )?ruby licen[sc]e"),
    ("postgresql", "postgresql licen", r"(?:the )?postgresql licen[sc]e"),
    ("openssl", "openssl licen", r"(?:the )?openssl licen[sc]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e"),
    ("mulan", "mulan p", r"mulan (?:permissive software|public|psl) ?licen[sc]e"),
    ("sspl", "server side", r"server side public licen[sc]e"),
    ("elastic", "elastic licen", r"(?:the )?elastic licen[sc]e"),
    ("busl", "business source", r"business source licen[sc]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use) licen[sc]e"),
    ("beerware", "beerware|beer-ware", r"(?:beerware|beer-ware) licen[sc]e"),
    ("vim", "vim licen", r"(?:the )?vim licen[sc]e"),
    ("curl", "curl licen", r"(?:the )?curl licen[sc]e"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("nasa", "nasa open", r"nasa open source agreement"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    ("zpl", "zope", r"zope public licen[sc]e"),
    ("ipl", "ibm public", r"ibm public licen[sc]e"),
    ("spl", "sun public", r"sun public licen[sc]e"),
    ("apsl", "apple public", r"apple public source licen[sc]e"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e"),
    ("freetype", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("llama", "llama", r"llama(?: \d(?:\.\d)?)? community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("openrail", "rail", r"(?:big ?science |creativeml )?open ?rail(?:-m|\+\+)? licen[sc]e"),
    ("etalab", "licence ouverte", r"licence ouverte(?: / open licen[sc]e)?"),
    ("ogl", "open government", r"open government licen[sc]e"),
    ("cdla", "community data", r"community data licen[sc]e agreement"),
]
#: Tables with their priority and confidence.
TABLES = [("tag", TAGS, 100, 1.0), ("sentence", SENTENCES, 90, 0.95), ("field", FIELDS, 85, 0.97), ("grant", GRANTS, 80, 0.98), ("version", VERSIONS, 70, 0.95), ("address", ADDRESSES, 60, 0.9), ("name", NAMES, 50, 0.85)]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order of priority, then of the tables; a match neither begins nor ends inside a word."""
    out = []
    for kind, table, priority, confidence in TABLES:
        for n, (label, keywords, pattern) in enumerate(table):
            end = "" if kind == "address" else r"(?!\w)"
            out.append(Rule(f"{kind}-{label}-{n}", label, tuple(keywords.split("|")), re.compile(rf"(?<!\w)(?:{pattern}){end}"), priority, confidence))
    return out
