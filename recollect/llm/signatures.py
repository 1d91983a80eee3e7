"""Signatures of the wording of licenses, written by hand: label, priority class, keyword and pattern.

Keywords and patterns are over lower-case words with one space between them.  A rule is only tried where its keyword stands.
BODY is the wording of a license itself, HEADER a notice that applies one to a file, URL an address of its text, and HINT
wording that several licenses of a family share.
"""

from __future__ import annotations

BODY, HEADER, URL, HINT = 85, 75, 90, 45

_ANY = r"(?: \S+){0,12}?"  # a name, or a few words that differ

#: (fixed values)
SIGNATURES = [
    # MIT, X11 and their kin
    ("mit", BODY, "obtaining a copy of this software", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation(?: files)?"),
    ("mit", BODY, "deal in the software", r"to deal in the software without restriction including without limitation(?: on)? the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", BODY, "substantial portions of the software", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", HINT, "merchantability fitness", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", BODY, "associated documentation", r"associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("json", BODY, "good not evil", r"the software shall be used for good not evil"),
    ("curl", BODY, "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided"),
    ("ncsa", BODY, "deal with the software", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("ncsa", HEADER, "illinois", r"university of illinois(?: ncsa)? open source license"),
    # BSD
    ("bsd", BODY, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", HINT, "redistributions of source code", r"redistributions of source code must retain the(?: above)? copyright notice this list of conditions and the following disclaimer"),
    ("bsd", HINT, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd-3-clause", BODY, "endorse or promote", rf"neither the names? of{_ANY} nor the names of(?: its| their| any)? contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", BODY, "endorse or promote", r"the names? of the (?:author|copyright holder|contributors?) may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", BODY, "patent rights are granted", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", BODY, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", HINT, "as is and any express", rf"this software is provided by{_ANY} as is and any express or implied warranties"),
    ("openssl", BODY, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", BODY, "eric young", r"this product includes cryptographic software written by eric young"),
    ("bsd", HEADER, "bsd style license", r"(?:use of this source code is )?governed by a bsd style license"),
    # ISC and historical permission notices
    ("isc", BODY, "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", BODY, "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", BODY, "permission to use copy modify", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("ntp", BODY, "makes no representations about the suitability", r"makes no representations about the suitability(?: of)? this software for any purpose it is provided as is without express or implied warranty"),
    ("tcl", BODY, "authors hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("postgresql", BODY, "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("w3c", BODY, "w3c", r"w3c software(?: and document)? notice and license"),
    ("naist", BODY, "nara institute", r"use reproduction and distribution of this software is permitted any copy of this software whether in its original form or modified"),
    # zlib, libpng, boost and other short ones
    ("zlib", BODY, "held liable for any damages", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", BODY, "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", BODY, "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", HINT, "removed or altered from any", r"this notice may not be removed or altered from any source(?: or binary)? distribution"),
    ("boost-1.0", BODY, "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", HEADER, "license 1 0 txt", r"see(?: the)? accompanying file license 1 0 txt"),
    ("ijg", BODY, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", BODY, "freetype", r"portions of this software are copyright(?: c)?(?: \d+)? the freetype project"),
    ("beerware", BODY, "beer ware license", r"the beer ware license"),
    ("beerware", BODY, "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", BODY, "do what the fuck", r"you just do what the fuck you want to"),
    ("unlicense", BODY, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", BODY, "free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", BODY, "recognize copyright laws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("unicode", BODY, "unicode data files", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", HEADER, "icu license", r"icu license icu 1 8 1 and later"),
    ("imagemagick", HEADER, "imagemagick", r"imagemagick org(?: script)? license"),
    ("ruby", BODY, "ruby", r"you can redistribute it and or modify it under either the terms of the(?: 2 clause bsdl| gpl)"),
    ("php", HEADER, "php license", r"this source file is subject to version 3 0(?: 1)? of the php license"),
    ("php", BODY, "products derived from this software may not be called php", r"products derived from this software may not be called php"),
    ("zpl", HEADER, "zope public license", r"this software is subject to the provisions of the zope public license"),
    ("sleepycat", BODY, "accompanying software that uses", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the(?: db)? software and any accompanying software that uses"),
    ("psf-2.0", BODY, "psf is making python", r"psf is making python available to licensee on an as is basis"),
    ("psf-2.0", BODY, "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("cnri", BODY, "cnri", r"cnri is making(?: this)? (?:python|software)(?: \d)*(?: software)? available to licensee on an as is basis"),
    # Apache
    ("apache-2.0", HEADER, "in compliance with the license", r"licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2.0", HEADER, "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", HEADER, "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", BODY, "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", BODY, "grant of copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", BODY, "terms and conditions for use", r"terms and conditions for use reproduction and distribution(?: 1)? definitions"),
    ("apache-1.1", BODY, "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("ecl-2.0", HEADER, "educational community license", r"licensed under the educational community license version 2 0"),
    # GNU
    ("gpl", HEADER, "this program is free software", r"this (?:program|file|software) is free software(?: you can redistribute it and or modify it under the terms of the gnu general public license)?"),
    ("gpl-2.0-or-later", HEADER, "version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", HEADER, "version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", HEADER, "version 2", r"gnu general public license(?: as published by the free software foundation)? version 2(?: of the license)? only"),
    ("gpl-2.0", HEADER, "general public license version 2", r"under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl", HINT, "hope that it will be useful", r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", HEADER, "you should have received", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", HINT, "verbatim copies of this license", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", BODY, "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", BODY, "copyleft license for software", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", BODY, "anti circumvention law", r"protecting users legal rights from anti circumvention law"),
    ("gpl-with-classpath-exception", BODY, "classpath exception", r"(?:subject to the )?classpath exception"),
    ("gpl-with-linking-exception", BODY, "as a special exception", rf"as a special exception{_ANY} (?:permission|give you permission|gives permission) to link"),
    ("gpl-with-gcc-exception", BODY, "gcc runtime library exception", r"gcc runtime library exception"),
    ("lgpl", HEADER, "this library is free software", r"this library is free software(?: you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license)?"),
    ("lgpl-2.1-or-later", HEADER, "version 2 1 of the license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", HEADER, "version 3 of the license", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", HEADER, "library general public license", r"gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", HEADER, "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", BODY, "successor of the gnu library", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("lgpl-3.0", BODY, "supplemented by the additional permissions", r"version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("agpl", HEADER, "you should have received", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", BODY, "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl-3.0", BODY, "remotely through a computer network", r"prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0-or-later", HEADER, "version 3 of the license", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", HEADER, "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", BODY, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gnu-all-permissive", BODY, "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-unlimited", BODY, "free software foundation", r"the free software foundation gives unlimited permission to copy and or distribute it"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2.0", HEADER, "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", HEADER, "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", HEADER, "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", HEADER, "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl", HEADER, "netscape public license", r"the contents of this file are subject to the netscape public license"),
    ("mpl-2.0", BODY, "incompatible with secondary licenses", r"incompatible with secondary licenses"),
    ("epl-1.0", HEADER, "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )?1 0"),
    ("epl-2.0", HEADER, "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v|v| version)? ?2 0"),
    ("epl", BODY, "accompanying program is provided", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", BODY, "accompanying program is provided", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", BODY, "ibm public license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("edl-1.0", HEADER, "eclipse distribution license", r"eclipse distribution license v(?:ersion)? ?1 0"),
    ("cddl", HEADER, "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", HEADER, "cddl header", r"cddl header start"),
    ("apsl", HEADER, "apple public source license", r"subject to the apple public source license version \d \d"),
    ("ms-pl", BODY, "bear the risk of using it", r"the software is licensed as is you bear the risk of using it"),
    ("eupl", HEADER, "eupl", r"licensed under the eupl(?: version \d \d)?"),
    ("cecill", HEADER, "cecill", r"this software is governed by the cecill(?: b| c)? license under french law"),
    ("osl-3.0", BODY, "open software license", r"this open software license the license applies to any original work of authorship"),
    ("afl-3.0", BODY, "academic free license", r"this academic free license the license applies to any original work of authorship"),
    ("artistic", BODY, "artistic control", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic", HEADER, "same terms as perl", r"redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("ofl-1.1", HEADER, "font software is licensed", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", BODY, "collaborative font projects", r"to stimulate worldwide development of collaborative font projects"),
    # Creative Commons, data and dedications
    ("cc", HEADER, "creative commons", r"this work is licensed under (?:a|the) creative commons"),
    ("cc", BODY, "redistribute the material", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", BODY, "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", BODY, "noncommercial", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", BODY, "same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", BODY, "distribute the modified material", r"you may not distribute the modified material"),
    ("cc0-1.0", BODY, "to the extent possible under law", rf"to the extent possible under law{_ANY} has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", HEADER, "dedicated this work", r"dedicated this work to the public domain"),
    ("public-domain", HEADER, "public domain", r"(?:placed|released|put) (?:in|into) the public domain"),
    ("pddl-1.0", HEADER, "public domain dedication", r"open data commons public domain dedication and license"),
    ("odbl-1.0", HEADER, "open database license", r"this database is made available under the open database license"),
    ("odc-by-1.0", HEADER, "open data commons", r"this database is made available under the open data commons attribution license"),
    ("ogl", HEADER, "open government licen", r"open government licen[cs]e(?: v\d(?: \d)?)?"),
    # Source available
    ("busl-1.1", HEADER, "business source license", r"business source license(?: 1 1| version 1 1)?"),
    ("busl-1.1", BODY, "change license", r"on the change date(?: or the fourth anniversary)?"),
    ("sspl-1.0", HEADER, "server side public license", r"server side public license(?: v(?:ersion)? ?1)?"),
    ("elastic-2.0", HEADER, "elastic license", r"elastic license(?: 2 0| v2)?"),
    ("commons-clause", BODY, "commons clause", r"commons clause license condition"),
    ("commons-clause", BODY, "right to sell the software", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", HEADER, "polyform", r"polyform (?:noncommercial|shield|small business|strict|free trial|internal use|perimeter) license"),
    ("hippocratic", HEADER, "hippocratic license", r"hippocratic license(?: version)?(?: \d)?"),
    ("llama", HEADER, "community license agreement", r"llama \d(?: \d)? community license agreement"),
    ("openrail", HEADER, "license", r"(?:creativeml |bigscience )?open ?rail(?: m)? license"),
    # Addresses
    ("gpl-3.0", URL, "gnu org licenses gpl", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", URL, "gnu org licenses", r"gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl", URL, "gnu org licenses gpl", r"gnu org licenses gpl(?: html)?"),
    ("lgpl-3.0", URL, "gnu org licenses lgpl", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", URL, "gnu org licenses", r"gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("lgpl", URL, "gnu org licenses lgpl", r"gnu org licenses lgpl(?: html)?"),
    ("agpl-3.0", URL, "gnu org licenses agpl", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", URL, "gnu org licenses fdl", r"gnu org licenses fdl(?: 1 \d)?"),
    ("apache-2.0", URL, "apache org licenses", r"apache org licenses license 2 0"),
    ("mit", URL, "opensource org licenses mit", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("bsd-3-clause", URL, "opensource org licenses bsd", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", URL, "opensource org licenses bsd", r"opensource org licenses bsd 2 clause"),
    ("isc", URL, "opensource org licenses isc", r"opensource org licenses isc"),
    ("mpl-2.0", URL, "mozilla org", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-1.0", URL, "eclipse org", r"eclipse org legal epl v10"),
    ("epl-2.0", URL, "eclipse org", r"eclipse org legal epl(?: 2 0| v20)"),
    ("boost-1.0", URL, "boost org license", r"boost org license 1 0 txt"),
    ("unlicense", URL, "unlicense org", r"unlicense org"),
    ("wtfpl", URL, "wtfpl net", r"wtfpl net"),
    ("odbl-1.0", URL, "opendatacommons org", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", URL, "opendatacommons org", r"opendatacommons org licenses by"),
    ("pddl-1.0", URL, "opendatacommons org", r"opendatacommons org licenses pddl"),
    ("ofl-1.1", URL, "sil org ofl", r"scripts sil org ofl"),
    ("zlib", URL, "zlib net", r"zlib net zlib license html"),
    ("cecill", URL, "cecill info", r"cecill info"),
    ("cc0-1.0", URL, "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", URL, "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0"),
    *((f"cc-{k.replace(' ', '-')}-{v}", URL, "creativecommons org licenses", rf"creativecommons org licenses {k} {v.replace('.', ' ')}") for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
]
