"""Signatures of licences, notices and exceptions, written by hand as regexes over words parted by one space.

A text's words are lower-cased runs of letters, digits and non-ASCII characters, so "GPL-2.0+" is `gpl 2 0`. Each entry:
label, keyword, pattern, priority, weight. The keyword (alternatives parted by |) stands at a word's start in every match.
Priority 3: the wording of a licence, header or tag; 2: a sentence that names it; 1: its bare name.
"""

from __future__ import annotations

#: The GNU licences: headers, sentences of their texts, names.
GNU = [
    ("gpl-2.0-or-later", "either version", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 3, 1.0),
    ("gpl-3.0-or-later", "either version", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 3, 1.0),
    ("gpl-2.0-only", "general public licen", r"terms of the gnu general public license version 2 as published by the free software foundation", 3, 1.0),
    ("gpl-3.0-only", "general public licen", r"terms of the gnu general public license version 3 as published by the free software foundation", 3, 1.0),
    ("lgpl-2.1-or-later", "either version", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 3, 1.0),
    ("lgpl-3.0-or-later", "either version", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 3, 1.0),
    ("lgpl-2.0-or-later", "either version", r"gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version", 3, 1.0),
    ("agpl-3.0-or-later", "either version", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 3, 1.0),
    ("gpl", "free software you can", r"this program is free software you can redistribute it and or modify it", 3, 0.95),
    ("lgpl", "free software you can", r"this library is free software you can redistribute it and or modify it", 3, 0.95),
    ("gpl", "free software you can", r"(?:it|this file|this package|this script|this module) is free software you can redistribute it and or modify it", 3, 0.9),
    ("gpl", "should have received", r"you should have received a copy of the gnu general public license", 3, 0.95),
    ("lgpl", "should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 3, 0.95),
    ("agpl", "should have received", r"you should have received a copy of the gnu affero general public license", 3, 0.95),
    ("gfdl", "free documentation licen", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 3, 1.0),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 3, 0.9),
    ("gpl-1.0", "version 1 february 1989", r"gnu general public license version 1 february 1989", 3, 1.0),
    ("gpl-2.0", "version 2 june 1991", r"gnu general public license version 2 june 1991", 3, 1.0),
    ("gpl-3.0", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007", 3, 1.0),
    ("lgpl-2.0", "version 2 june 1991", r"gnu library general public license version 2 june 1991", 3, 1.0),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999", 3, 1.0),
    ("lgpl-3.0", "version 3 29 june 2007", r"gnu lesser general public license version 3 29 june 2007", 3, 1.0),
    ("agpl-3.0", "version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007", 3, 1.0),
    ("gfdl-1.3", "version 1 3 3 november 2008", r"gnu free documentation license version 1 3 3 november 2008", 3, 1.0),
    ("gpl", "guarantee your freedom", r"general public license is intended to guarantee your freedom to share and change", 3, 0.95),
    ("gpl", "copyleft", r"gnu general public license is a free copyleft license for software", 3, 0.95),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license", 3, 0.95),
    ("gpl", "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty", 3, 0.7),
    ("gpl", "without even the implied", r"without even the implied warranty of merchantability or fitness for a particular purpose", 3, 0.7),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: (?:version|v))? (?:v3|3)(?: 0)?", 1, 0.6),
    ("agpl", "affero", r"(?:gnu )?affero general public license", 1, 0.6),
    ("agpl", "agpl", r"agpl(?:v3| v3| 3 0| 3)?", 1, 0.6),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: (?:version|v))? (?:v2|2) 1", 1, 0.6),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: (?:version|v))? (?:v3|3)(?: 0)?", 1, 0.6),
    ("lgpl", "lesser|library general", r"(?:gnu )?(?:lesser|library) general public license", 1, 0.6),
    ("lgpl-2.1", "lgpl", r"lgpl(?: v2 1|v2 1| 2 1)", 1, 0.6),
    ("lgpl-3.0", "lgpl", r"lgpl(?: v3|v3| 3 0| 3)", 1, 0.6),
    ("lgpl", "lgpl", r"lgpl(?:v2| v2)?", 1, 0.6),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: (?:version|v))? (?:v2|2)(?: 0)?", 1, 0.6),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: (?:version|v))? (?:v3|3)(?: 0)?", 1, 0.6),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", 1, 0.6),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?:v2| v2| 2 0| 2)", 1, 0.6),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?:v3| v3| 3 0| 3)", 1, 0.6),
    ("gpl", "gnu gpl", r"gnu gpl", 1, 0.6),
    ("gfdl", "free documentation|gfdl", r"(?:(?:gnu )?free documentation license(?: (?:version )?1 [123])?|gfdl)", 1, 0.6),
    ("gpl", "licensed under the gpl|released under the gpl|distributed under the gpl|covered by the gpl", r"(?:licensed under|released under|distributed under|covered by) the gpl", 2, 0.9),
    ("lgpl", "licensed under the lgpl|released under the lgpl|distributed under the lgpl", r"(?:licensed|released|distributed) under the lgpl", 2, 0.9),
]

#: Permissive licences: headers, sentences of their texts, names.
PERMISSIVE = [
    ("apache-2.0", "apache licen", r"licensed under the apache license version 2 0(?: the license)?", 3, 1.0),
    ("apache-2.0", "apache org licenses licen", r"www apache org licenses license 2 0", 3, 0.95),
    ("apache-2.0", "may not use this file", r"you may not use this file except in compliance with the license", 3, 0.9),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 3, 0.95),
    ("apache-2.0", "licensed to the apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 3, 1.0),
    ("apache-2.0", "apache licen", r"apache license version 2 0 january 2004", 3, 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 3, 0.9),
    ("apache-2.0", "apache", r"apache(?: software)? license(?: (?:version|v))? (?:v2|2)(?: 0)?", 1, 0.6),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 [01]", 1, 0.6),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", 1, 0.6),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?(?: licen[sc]e)?", 1, 0.6),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, 1.0),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 0.95),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 3, 0.95),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3, 0.95),
    ("mit", "authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 3, 0.85),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?", 2, 0.9),
    ("mit", "mit licen|mit x11 licen|expat licen|expat x11 licen", r"(?:mit|expat)(?: x11)? licen[sc]e", 1, 0.6),
    ("mit", "licensed under mit|released under mit|licensed under the mit|released under the mit", r"(?:licensed|released) under (?:the )?mit", 2, 0.9),
    ("mit", "mit style licen", r"mit style licen[sc]e", 2, 0.8),
    ("x11", "x consortium", r"name of the x consortium shall not be used in advertising", 3, 0.95),
    ("x11", "x11 licen", r"x11 licen[sc]e", 1, 0.6),
    ("hpnd", "advertising or publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", 3, 0.85),
    ("isc", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("isc", "permission to use copy", r"permission to use copy modify and(?: or)? distribute this software", 3, 0.9),
    ("0bsd", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 3, 1.0),
    ("isc", "isc licen", r"isc licen[sc]e", 1, 0.6),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 3, 0.9),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.95),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 3, 0.95),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 3, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 3, 1.0),
    ("bsd-4-clause", "university of california", r"software developed by the university of california berkeley and its contributors", 3, 0.95),
    ("bsd-2-clause-patent", "patent license to make", r"grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable patent license to make", 3, 0.9),
    ("bsd-3-clause-clear", "express or implied licenses to any", r"no express or implied licenses to any party s patent rights are granted by this license", 3, 0.95),
    ("bsd-3-clause-no-nuclear", "nuclear facility", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 3, 0.9),
    ("bsd", "regents of the university", r"copyright (?:c )?(?:[0-9]{4} )?the regents of the university of california", 3, 0.8),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", 1, 0.6),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", 1, 0.6),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", 1, 0.6),
    ("0bsd", "bsd|0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)(?: licen[sc]e)?", 1, 0.6),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[sc]e", 1, 0.6),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 3, 1.0),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 3, 1.0),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty", 3, 0.7),
    ("zlib", "zlib licen|zlib libpng licen", r"zlib(?: libpng)? licen[sc]e", 1, 0.6),
    ("libpng-2.0", "png reference library licen", r"png reference library license version 2", 3, 0.95),
    ("bsl-1.0", "boost software licen", r"boost software license version 1 0 17 august 2003", 3, 1.0),
    ("bsl-1.0", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor", 3, 0.95),
    ("bsl-1.0", "boost software", r"boost software license", 1, 0.6),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 3, 1.0),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3, 0.95),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 1, 0.6),
    ("wtfpl", "what the f", r"do what the f[a-z]{2,3} you want to public license", 3, 1.0),
    ("wtfpl", "wtfpl", r"wtfpl", 1, 0.6),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", 1, 0.6),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted", 3, 0.9),
    ("ncsa", "university of illinois", r"university of illinois(?: ncsa)? open source license", 1, 0.7),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction", 3, 0.9),
    ("python-2.0", "psf is making python available", r"psf is making python available to licensee on an as is basis", 3, 1.0),
    ("python-2.0", "python software foundation licen", r"python software foundation license(?: version 2)?", 1, 0.7),
    ("php-3.01", "this product includes php", r"this product includes php(?: software)? freely available from", 3, 0.95),
    ("php", "php licen", r"php license(?: version)?(?: 3 0(?:1)?)?", 1, 0.6),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 3, 1.0),
    ("openssl", "openssl licen", r"openssl licen[sc]e", 1, 0.6),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 3, 1.0),
    ("curl", "curl licen", r"curl licen[sc]e", 1, 0.6),
    ("ruby", "ruby licen|ruby s licen", r"ruby(?: s)? licen[sc]e", 1, 0.6),
    ("vim", "vim licen", r"vim licen[sc]e", 1, 0.6),
    ("blessing", "may you do good", r"may you do good and not evil", 3, 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 3, 1.0),
    ("beerware", "beer ware", r"the beer ware license(?: revision 42)?", 2, 0.9),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 3, 0.95),
    ("ftl", "freetype", r"portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project", 3, 0.95),
    ("ftl", "freetype project licen|freetype licen", r"freetype(?: project)? licen[sc]e", 1, 0.6),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 3, 0.95),
    ("unicode-dfs-2016", "unicode inc licen", r"unicode inc license agreement data files and software", 3, 0.95),
    ("unicode-dfs-2016", "unicode terms of use|unicode licen", r"unicode (?:terms of use|licen[sc]e)", 1, 0.5),
    ("icu", "icu licen", r"icu license(?: icu 1 8 1 and later)?", 1, 0.6),
    ("mit-cmu", "cmu licen", r"cmu licen[sc]e", 1, 0.5),
    ("tcl", "authors hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software", 3, 0.95),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: (?:version|v) ?1(?: 0)?)?", 1, 0.7),
    ("afl-3.0", "academic free", r"academic free license(?: (?:version|v))?(?: [123] [0-9])?", 1, 0.7),
    ("ecl-2.0", "educational community", r"educational community license(?: version 2 0)?", 1, 0.7),
    ("w3c", "w3c software", r"w3c software (?:and document )?(?:notice and )?licen[sc]e", 1, 0.7),
    ("fair", "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained with the works", 3, 1.0),
    ("blueoak-1.0.0", "blue oak", r"blue oak model license(?: 1 0 0)?", 1, 0.8),
    ("mulan-psl-2.0", "mulan", r"mulan p(?:ermissive software licen[sc]e|sl)(?: v2)?", 1, 0.8),
    ("artistic-2.0", "artistic licen", r"artistic license(?: (?:version|v))? 2(?: 0)?", 1, 0.6),
    ("artistic-1.0", "artistic control", r"copyright holder maintains some semblance of artistic control over the development of the package", 3, 1.0),
    ("artistic", "artistic licen", r"artistic licen[sc]e", 1, 0.6),
    ("perl", "same terms as perl", r"under the same terms as perl(?: itself)?", 2, 0.9),
    ("ntp", "ntp licen", r"ntp licen[sc]e", 1, 0.5),
    ("zpl-2.1", "zope public", r"zope public license(?: zpl)?(?: version 2 [01])?", 1, 0.7),
]

#: Licences with file- or library-wide copyleft, and business licences: headers, names.
RECIPROCAL = [
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", 3, 1.0),
    ("mpl-2.0", "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 3, 1.0),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licenses", 3, 0.9),
    ("mpl-1.1", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 1", 3, 1.0),
    ("npl-1.1", "netscape public", r"netscape public license(?: version 1 [01])?", 1, 0.7),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: (?:version|v))? (?:v2|2)(?: 0)?", 1, 0.6),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: (?:version|v))? 1 1", 1, 0.6),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", 1, 0.6),
    ("mpl-2.0", "mpl", r"mpl(?:v2| v2| 2 0| 2)", 1, 0.6),
    ("epl-2.0", "eclipse public licen", r"made available under the terms of the eclipse public license (?:version |v |v)?2 0", 3, 1.0),
    ("epl-1.0", "eclipse public licen", r"made available under the terms of the eclipse public license (?:version |v |v)?1 0", 3, 1.0),
    ("epl-2.0", "eclipse", r"eclipse public license(?: (?:version|v))? (?:v2|2)(?: 0)?", 1, 0.6),
    ("epl-1.0", "eclipse", r"eclipse public license(?: (?:version|v))? (?:v1|1)(?: 0)?", 1, 0.6),
    ("epl", "eclipse", r"eclipse public licen[sc]e", 1, 0.6),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e", 1, 0.6),
    ("cddl-1.0", "common development", r"subject to the terms of the common development and distribution license", 3, 0.95),
    ("cddl-1.1", "common development", r"common development and distribution license(?: cddl)?(?: version)? 1 1", 1, 0.7),
    ("cddl-1.0", "common development", r"common development and distribution license(?: cddl)?(?: version)? 1 0", 1, 0.7),
    ("cddl", "common development|cddl", r"(?:common development and distribution licen[sc]e|cddl)", 1, 0.6),
    ("cpl-1.0", "common public licen", r"common public license(?: (?:version|v))?(?: 1 0)?", 1, 0.6),
    ("ipl-1.0", "ibm public", r"ibm public license(?: version 1 0)?", 1, 0.6),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e(?: eupl)?(?: v| version) ?1 2", 1, 0.8),
    ("eupl", "european union public|eupl", r"(?:european union public licen[sc]e|eupl)", 1, 0.6),
    ("osl-3.0", "open software licen", r"open software license(?: (?:version|v))?(?: [123] [0-9])?", 1, 0.6),
    ("qpl-1.0", "q public", r"q public license(?: version 1 0)?", 1, 0.6),
    ("apsl-2.0", "apple public source", r"apple public source license(?: version)?(?: [12] [0-9])?", 1, 0.7),
    ("rpl-1.5", "reciprocal public", r"reciprocal public license(?: 1 5)?", 1, 0.7),
    ("ms-pl", "microsoft public licen|ms pl", r"(?:microsoft public license(?: ms pl)?|ms pl)", 1, 0.7),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", 1, 0.7),
    ("spl-1.0", "sun public", r"sun public licen[sc]e", 1, 0.6),
    ("sissl", "sun industry standards", r"sun industry standards source licen[sc]e", 1, 0.7),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", 1, 0.7),
    ("cecill-2.1", "cecill", r"cecill(?: [bc])?(?: free software license agreement)?(?: (?:version|v) ?2 [01])?", 1, 0.7),
    ("cecill", "governed by the cecill", r"this software is governed by the cecill(?: [bc])? license under french law", 3, 1.0),
    ("watcom-1.0", "sybase open watcom", r"sybase open watcom public licen[sc]e", 1, 0.7),
    ("lppl-1.3c", "latex project public", r"distributed and or modified under the conditions of the latex project public license", 3, 1.0),
    ("lppl", "latex project public", r"latex project public licen[sc]e", 1, 0.6),
    ("sspl-1.0", "server side public", r"server side public license(?: (?:version|v) ?1)?", 1, 0.8),
    ("busl-1.1", "business source licen", r"business source license(?: 1 1)?", 1, 0.8),
    ("busl-1.1", "additional use grant", r"the licensor may make an additional use grant above permitting limited production use", 3, 0.95),
    ("elastic-2.0", "elastic licen", r"elastic license(?: (?:version |v)?2(?: 0)?)?", 1, 0.8),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 3, 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: license condition v1 0)?", 1, 0.8),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial", r"polyform noncommercial license(?: 1 0 0)?", 1, 0.8),
    ("polyform-small-business-1.0.0", "polyform small business", r"polyform small business license(?: 1 0 0)?", 1, 0.8),
    ("parity-7.0.0", "parity public", r"parity public license(?: 7 0 0)?", 1, 0.8),
    ("prosperity-3.0.0", "prosperity public", r"prosperity public license(?: 3 0 0)?", 1, 0.8),
    ("hippocratic-2.1", "hippocratic", r"hippocratic license(?: 2 [01])?", 1, 0.8),
]

#: Creative Commons: names, addresses, sentences; then data, fonts, models and documents.
CONTENT = [
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 1, 0.6),
    ("cc0-1.0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", 3, 1.0),
    ("cc0-1.0", "dedicated the work to the public", r"has dedicated the work to the public domain by waiving all of his or her rights", 3, 1.0),
    ("cc-pdm-1.0", "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", 3, 1.0),
    ("cc-by-4.0", "creativecommons org licenses by", r"creativecommons org licenses by 4 0", 3, 1.0),
    ("cc-by-3.0", "creativecommons org licenses by", r"creativecommons org licenses by 3 0", 3, 1.0),
    ("cc-by-sa-4.0", "creativecommons org licenses by", r"creativecommons org licenses by sa 4 0", 3, 1.0),
    ("cc-by-sa-3.0", "creativecommons org licenses by", r"creativecommons org licenses by sa 3 0", 3, 1.0),
    ("cc-by-nc-4.0", "creativecommons org licenses by", r"creativecommons org licenses by nc 4 0", 3, 1.0),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by", r"creativecommons org licenses by nc sa 4 0", 3, 1.0),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by", r"creativecommons org licenses by nc nd 4 0", 3, 1.0),
    ("cc-by-nd-4.0", "creativecommons org licenses by", r"creativecommons org licenses by nd 4 0", 3, 1.0),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-4.0", "cc by", r"cc by 4 0", 1, 0.6),
    ("cc-by-3.0", "cc by", r"cc by 3 0", 1, 0.6),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative work|ative)s", 1, 0.7),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 1, 0.7),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", 1, 0.6),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?derivatives(?: [1-4] [05])?", 1, 0.6),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?", 1, 0.6),
    ("creative-commons", "creative commons", r"creative commons", 1, 0.5),
    ("cc-by", "this work is licensed", r"this work is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international)?(?: license)?", 3, 0.95),
    ("cc-by-sa", "available under the creative commons", r"text is available under the creative commons attribution share ?alike license", 3, 0.95),
    ("odbl-1.0", "open database licen", r"made available under the open database license", 3, 0.95),
    ("odbl-1.0", "open database licen|odbl", r"(?:open database licen[sc]e|odbl)", 1, 0.6),
    ("odc-by-1.0", "open data commons attribution", r"open data commons attribution licen[sc]e", 1, 0.7),
    ("pddl-1.0", "open data commons public domain", r"open data commons public domain dedication and licen[sc]e", 1, 0.7),
    ("cdla-permissive-2.0", "community data licen", r"community data license agreement permissive(?: (?:version )?[12] 0)?", 1, 0.8),
    ("cdla-sharing-1.0", "community data licen", r"community data license agreement sharing(?: (?:version )?1 0)?", 1, 0.8),
    ("ogl-uk-3.0", "open government licen", r"contains public sector information licensed under the open government licence v3 0", 3, 1.0),
    ("ogl-uk", "open government licen", r"open government licen[sc]e(?: v[123] 0)?", 1, 0.6),
    ("dl-de-by-2.0", "datenlizenz deutschland", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", 1, 0.8),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: open licence)?(?: (?:version )?2 0)?", 1, 0.8),
    ("ofl-1.1", "sil open font", r"this font software is licensed under the sil open font license version 1 1", 3, 1.0),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: ofl)?(?: (?:version|v))?(?: 1 [01])?", 1, 0.6),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name", 3, 0.95),
    ("ubuntu-font-1.0", "ubuntu font", r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?", 1, 0.7),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream inc", 3, 0.9),
    ("gust-font", "gust font", r"gust font licen[sc]e", 1, 0.7),
    ("openrail-m", "open rail m|openrail", r"(?:open rail m|openrail(?: m)?|creativeml open rail m)(?: licen[sc]e)?", 1, 0.7),
    ("free-art-1.3", "free art licen", r"free art licen[sc]e(?: 1 3)?", 1, 0.6),
    ("opl-1.0", "open publication licen", r"open publication license(?: v1 0)?", 1, 0.6),
    ("ogl-1.0a", "open game licen", r"open game license(?: version 1 0a)?", 1, 0.6),
    ("w3c-doc", "w3c document licen", r"w3c document licen[sc]e", 1, 0.6),
    ("gutenberg", "project gutenberg", r"project gutenberg(?: tm)? license", 2, 0.9),
    ("gutenberg", "no restrictions whatsoever", r"at no cost and with almost no restrictions whatsoever", 3, 0.95),
]

#: Tags of one licence: `SPDX-License-Identifier: ...`.
SPDX = [
    ("gpl-2.0-only", "spdx licen", r"spdx license identifier gpl 2 0(?: only)?", 3, 1.0),
    ("gpl-2.0-or-later", "spdx licen", r"spdx license identifier gpl 2 0 or later", 3, 1.0),
    ("gpl-3.0-only", "spdx licen", r"spdx license identifier gpl 3 0(?: only)?", 3, 1.0),
    ("gpl-3.0-or-later", "spdx licen", r"spdx license identifier gpl 3 0 or later", 3, 1.0),
    ("lgpl-2.1-only", "spdx licen", r"spdx license identifier lgpl 2 [01](?: only)?", 3, 1.0),
    ("lgpl-2.1-or-later", "spdx licen", r"spdx license identifier lgpl 2 [01] or later", 3, 1.0),
    ("lgpl-3.0-only", "spdx licen", r"spdx license identifier lgpl 3 0(?: only)?", 3, 1.0),
    ("lgpl-3.0-or-later", "spdx licen", r"spdx license identifier lgpl 3 0 or later", 3, 1.0),
    ("agpl-3.0-only", "spdx licen", r"spdx license identifier agpl 3 0(?: only)?", 3, 1.0),
    ("agpl-3.0-or-later", "spdx licen", r"spdx license identifier agpl 3 0 or later", 3, 1.0),
    ("gfdl-1.3", "spdx licen", r"spdx license identifier gfdl 1 [123](?: only| or later)?", 3, 1.0),
    ("apache-2.0", "spdx licen", r"spdx license identifier apache 2 0", 3, 1.0),
    ("mit", "spdx licen", r"spdx license identifier mit", 3, 1.0),
    ("mit-0", "spdx licen", r"spdx license identifier mit 0", 3, 1.0),
    ("x11", "spdx licen", r"spdx license identifier x11", 3, 1.0),
    ("isc", "spdx licen", r"spdx license identifier isc", 3, 1.0),
    ("0bsd", "spdx licen", r"spdx license identifier 0bsd", 3, 1.0),
    ("bsd-1-clause", "spdx licen", r"spdx license identifier bsd 1 clause", 3, 1.0),
    ("bsd-2-clause", "spdx licen", r"spdx license identifier bsd 2 clause", 3, 1.0),
    ("bsd-3-clause", "spdx licen", r"spdx license identifier bsd 3 clause", 3, 1.0),
    ("bsd-4-clause", "spdx licen", r"spdx license identifier bsd 4 clause", 3, 1.0),
    ("mpl-1.1", "spdx licen", r"spdx license identifier mpl 1 1", 3, 1.0),
    ("mpl-2.0", "spdx licen", r"spdx license identifier mpl 2 0", 3, 1.0),
    ("epl-1.0", "spdx licen", r"spdx license identifier epl 1 0", 3, 1.0),
    ("epl-2.0", "spdx licen", r"spdx license identifier epl 2 0", 3, 1.0),
    ("cddl-1.0", "spdx licen", r"spdx license identifier cddl 1 0", 3, 1.0),
    ("eupl-1.2", "spdx licen", r"spdx license identifier eupl 1 2", 3, 1.0),
    ("osl-3.0", "spdx licen", r"spdx license identifier osl 3 0", 3, 1.0),
    ("artistic-2.0", "spdx licen", r"spdx license identifier artistic 2 0", 3, 1.0),
    ("bsl-1.0", "spdx licen", r"spdx license identifier bsl 1 0", 3, 1.0),
    ("zlib", "spdx licen", r"spdx license identifier zlib", 3, 1.0),
    ("unlicense", "spdx licen", r"spdx license identifier unlicense", 3, 1.0),
    ("wtfpl", "spdx licen", r"spdx license identifier wtfpl", 3, 1.0),
    ("cc0-1.0", "spdx licen", r"spdx license identifier cc0 1 0", 3, 1.0),
    ("cc-by-4.0", "spdx licen", r"spdx license identifier cc by 4 0", 3, 1.0),
    ("cc-by-sa-4.0", "spdx licen", r"spdx license identifier cc by sa 4 0", 3, 1.0),
    ("cc-by-nc-4.0", "spdx licen", r"spdx license identifier cc by nc 4 0", 3, 1.0),
    ("ncsa", "spdx licen", r"spdx license identifier ncsa", 3, 1.0),
    ("postgresql", "spdx licen", r"spdx license identifier postgresql", 3, 1.0),
    ("python-2.0", "spdx licen", r"spdx license identifier (?:python|psf) 2 0", 3, 1.0),
    ("ofl-1.1", "spdx licen", r"spdx license identifier ofl 1 1", 3, 1.0),
    ("upl-1.0", "spdx licen", r"spdx license identifier upl 1 0", 3, 1.0),
    ("ms-pl", "spdx licen", r"spdx license identifier ms pl", 3, 1.0),
    ("openssl", "spdx licen", r"spdx license identifier openssl", 3, 1.0),
    ("sspl-1.0", "spdx licen", r"spdx license identifier sspl 1 0", 3, 1.0),
    ("busl-1.1", "spdx licen", r"spdx license identifier busl 1 1", 3, 1.0),
    ("licenseref", "spdx licen", r"spdx license identifier licenseref", 3, 0.8),
]

#: Exceptions to a licence.
EXCEPTIONS = [
    ("classpath-exception-2.0", "classpath exception", r"classpath exception(?: 2 0)?", 2, 0.9),
    ("classpath-exception-2.0", "independent modules", r"permission to link this library with independent modules to produce an executable", 3, 1.0),
    ("gcc-exception-3.1", "gcc runtime library exception", r"gcc runtime library exception(?: version)?(?: 3 1)?", 2, 0.9),
    ("gcc-exception-2.0", "unlimited permission to link", r"unlimited permission to link the compiled version of this file into combinations with other programs", 3, 1.0),
    ("autoconf-exception", "configuration script generated by autoconf", r"as part of a program that contains a configuration script generated by autoconf", 3, 1.0),
    ("bison-exception-2.2", "as long as that work", r"as long as that work isn t itself a parser generator using the(?: bison parser)? skeleton", 3, 1.0),
    ("llvm-exception", "llvm exception", r"(?:with )?llvm exceptions?", 2, 0.9),
    ("linux-syscall-note", "linux syscall note", r"linux syscall note", 2, 0.9),
    ("openssl-exception", "openssl library", r"permission to link (?:the code of portions of )?this program with the openssl library", 3, 1.0),
    ("openvpn-openssl-exception", "openvpn with the openssl", r"link openvpn with the openssl library", 3, 0.9),
    ("font-exception-2.0", "embeds this font", r"if you create a document which uses this font and embeds this font", 3, 1.0),
    ("linking-exception", "special exception the copyright holders", r"as a special exception the copyright holders (?:of this library )?give (?:you )?permission", 3, 0.8),
    ("linking-exception", "statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work", 3, 0.9),
    ("u-boot-exception-2.0", "u boot exception", r"u boot exception(?: 2 0)?", 2, 0.8),
    ("qt-lgpl-exception-1.1", "qt lgpl exception", r"qt lgpl exception(?: version)?(?: 1 1)?", 2, 0.9),
    ("wxwindows-exception-3.1", "wxwindows library", r"wxwindows library licen[sc]e(?: version 3(?: 1)?)?", 2, 0.9),
]

#: Sentences that point to a licence, reserve rights, or grant them without a licence's name.
NOTICES = [
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 2, 0.7),
    ("public-domain", "placed in the public", r"(?:has been|is hereby|is) placed in the public domain", 3, 0.9),
    ("public-domain", "public domain dedication", r"public domain dedication", 2, 0.8),
    ("public-domain", "public domain", r"public domain", 1, 0.4),
    ("public-domain", "disclaims copyright|disclaim copyright", r"the author(?:s)? (?:hereby )?disclaims? copyright to this source code", 3, 0.95),
    ("public-domain", "work of the u s government|work of the united states government", r"work of the (?:u s|united states) government", 2, 0.8),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 2, 0.7),
    ("all-rights-reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 2, 0.7),
    ("all-rights-reserved", "tous droits", r"tous droits réservés", 2, 0.7),
    ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados", 2, 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 1, 0.3),
    ("copyright", "copyright", r"(?:19|20)[0-9][0-9] copyright", 1, 0.3),
    ("copyright", "spdx filecopyrighttext", r"spdx filecopyrighttext", 2, 0.5),
    ("proprietary", "confidential", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "confidential", r"confidential and proprietary", 2, 0.8),
    ("proprietary", "trade secret", r"(?:contains|constitutes|valuable) trade secrets?", 2, 0.7),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file(?: via any medium)? is strictly prohibited", 3, 0.95),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?: stored| copied| distributed| transmitted)? .{0,60}?without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 3, 0.8),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work) may be reproduced", 3, 0.9),
    ("proprietary", "end user licen", r"end user licen[sc]e agreement", 2, 0.8),
    ("proprietary", "evaluation purposes only", r"for (?:internal )?evaluation purposes only", 2, 0.7),
    ("proprietary", "commercial licen", r"(?:under a|requires a|separate) commercial licen[sc]e", 2, 0.7),
    ("non-commercial", "non commercial|noncommercial", r"for (?:non commercial|noncommercial) (?:use|purposes)(?: only)?", 2, 0.7),
    ("non-commercial", "personal use only", r"for personal use only", 2, 0.6),
    ("non-commercial", "academic|research", r"for (?:academic|research)(?: and (?:academic|research))? (?:use|purposes) only", 2, 0.7),
    ("non-commercial", "educational", r"for educational (?:use|purposes) only", 2, 0.6),
    ("free-use", "freely distributable", r"freely distributable", 1, 0.4),
    ("free-use", "royalty free", r"royalty free licen[sc]e", 1, 0.4),
    ("free-use", "used with permission", r"used with permission", 1, 0.3),
    ("license-reference", "licen", r"see (?:the )?(?:file )?licen[sc]e(?: file| txt| md)(?: in the project root)?(?: for (?:details|license information))?", 2, 0.5),
    ("license-reference", "governed by a", r"use of this source code is governed by a .{0,30}? ?style license that can be found in the license file", 3, 0.8),
    ("license-reference", "licensed under the same", r"licensed under the same (?:terms|license) as", 2, 0.5),
    ("license-reference", "for licen", r"for licen[sc]e information(?: please)? see", 1, 0.3),
    ("license-reference", "third party", r"third party (?:software )?(?:notices|licenses)", 1, 0.3),
    ("license-reference", "open source licen", r"(?:an |approved )?open source licen[sc]es?", 1, 0.3),
    ("cla", "contributor licen", r"(?:individual |corporate )?contributor license agreement", 2, 0.5),
    ("dco", "developer certificate of origin|developer s certificate of origin", r"developer(?: s)? certificate of origin(?: 1 1)?", 2, 0.5),
    ("warranty-disclaimer", "provided", r"provided (?:by .{1,60}? )?as is(?: and any express or implied warranties)?", 1, 0.3),
    ("warranty-disclaimer", "no event shall", r"in no event shall .{1,80}? be liable", 1, 0.3),
]

GROUPS = [GNU, PERMISSIVE, RECIPROCAL, CONTENT, SPDX, EXCEPTIONS, NOTICES]
