"""License scans by ordered signature rules.

A rule is a regular expression with a label, a priority, a relevance, a keyword
and a core. The keyword is a string that every match holds, as a word or as a part
of one ("gpl" in "lgplv2.1", "bsd" in "freebsd"); the core is the pattern of the
name, without its form, that every match holds too. A text is matched with a rule
only if it has the rule's keyword, and then the rule's core; neither test loses a match.
Detections are then taken by priority (then length, then place), and one that
lies inside a stretch already taken is dropped, so that a full license notice
hides the short mentions that it contains.

Signatures are written one by one. Beside them stand SPDX identifiers, and the
products of a table of license names and a table of statement forms, which differ
in the name only. A blank in a table's pattern stands for any white space, line
feeds too: wrapped notices are found. Three plain phrases are counted besides ("base"): places where their
words stand one after the other.

Defined results: null and empty texts have no words, no places and no labels, and
score 0; very long texts are scanned whole; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Names: label, keyword, pattern of the name in lower case.
NAMES = [
    ("apache-2.0", "apache", r"apache(?: software)? license(?:,? version)? 2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?:,? version)? 1\.1"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?:,? version)? 1\.0"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mit-0", "mit", r"mit no attribution(?: license)?"),
    ("x11", "x11", r"x11 license"),
    ("isc", "isc", r"isc license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? license"),
    ("bsd-0", "bsd", r"(?:zero|0)[- ]clause bsd license"),
    ("bsd-2", "bsd", r"(?:(?:2|two)[- ]clause bsd|simplified bsd|freebsd) license"),
    ("bsd-3", "bsd", r"(?:(?:3|three)[- ]clause bsd|new bsd|revised bsd|modified bsd) license"),
    ("bsd-4", "bsd", r"(?:(?:4|four)[- ]clause bsd|original bsd) license"),
    ("bsd", "bsd", r"bsd(?:-style)? license"),
    ("gpl-1", "gnu", r"gnu general public license,? (?:version |v)1(?:\.0)?"),
    ("gpl-2", "gnu", r"gnu general public license,? (?:version |v)2(?:\.0)?"),
    ("gpl-3", "gnu", r"gnu general public license,? (?:version |v)3(?:\.0)?"),
    ("gpl", "gnu", r"gnu general public license"),
    ("lgpl-2", "gnu", r"gnu (?:library|lesser) general public license,? (?:version |v)2(?:\.[01])?"),
    ("lgpl-3", "gnu", r"gnu lesser general public license,? (?:version |v)3(?:\.0)?"),
    ("lgpl", "gnu", r"gnu (?:library|lesser) general public license"),
    ("agpl-3", "gnu", r"gnu affero general public license(?:,? (?:version |v)3(?:\.0)?)?"),
    ("gfdl", "gnu", r"gnu free documentation license(?:,? version 1\.[123])?"),
    ("gpl-2", "gpl", r"gpl[- ]?v?2(?:\.0)?(?:\+|-only|-or-later)?"),
    ("gpl-3", "gpl", r"gpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?"),
    ("lgpl-2", "lgpl", r"lgpl[- ]?v?2(?:\.[01])?(?:\+|-only|-or-later)?"),
    ("lgpl-3", "lgpl", r"lgpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?"),
    ("agpl-3", "agpl", r"agpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license,? (?:version |v\. ?)?1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public license,? (?:version |v\. ?)?2\.0"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: -)?,? (?:version |v ?)?1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: -)?,? (?:version |v ?)?2\.0"),
    ("cddl", "cddl", r"cddl(?: ?1\.[01])?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl", "common", r"common public license"),
    ("artistic-1", "artistic", r"artistic license,? 1\.0"),
    ("artistic-2", "artistic", r"artistic license,? 2\.0"),
    ("artistic", "artistic", r"artistic license"),
    ("boost", "boost", r"boost software license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "python", r"python software foundation license"),
    ("php", "php", r"php license"),
    ("ruby", "ruby", r"ruby license"),
    ("openssl", "openssl", r"openssl license"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("ofl", "font", r"sil open font license"),
    ("odbl", "database", r"open database license"),
    ("odc-by", "odc", r"odc[- ]by"),
    ("cc0", "cc0", r"cc0(?: ?1\.0)?"),
    ("cc-by", "cc", r"cc[- ]by(?: ?[1-4]\.0)?(?![- ](?:sa|nc|nd))"),
    ("cc-by-sa", "cc", r"cc[- ]by[- ]sa(?: ?[1-4]\.0)?"),
    ("cc-by-nc", "cc", r"cc[- ]by[- ]nc(?: ?[1-4]\.0)?(?![- ](?:sa|nd))"),
    ("cc-by-nd", "cc", r"cc[- ]by[- ]nd(?: ?[1-4]\.0)?"),
    ("cc-by-nc-sa", "cc", r"cc[- ]by[- ]nc[- ]sa(?: ?[1-4]\.0)?"),
    ("cc-by-nc-nd", "cc", r"cc[- ]by[- ]nc[- ]nd(?: ?[1-4]\.0)?"),
    ("cc-by", "commons", r"creative commons attribution(?! ?-?(?:share|non|no ?deriv))(?: [1-4]\.0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-sa", "commons", r"creative commons attribution[- ]share ?-?alike(?: [1-4]\.0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", "commons", r"creative commons attribution[- ]non ?-?commercial(?: [1-4]\.0)?(?: international| unported| generic)?(?: license)?"),
    ("cc", "commons", r"creative commons licen[cs]e"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
]

# SPDX identifiers: label, pattern in lower case. They count after "SPDX-License-Identifier" only, anywhere in its expression.
SPDX = [
    ("apache-2.0", r"apache-2\.0"),
    ("apache-1.1", r"apache-1\.1"),
    ("apache-1.0", r"apache-1\.0"),
    ("mit", r"mit"),
    ("mit-0", r"mit-0"),
    ("x11", r"x11"),
    ("isc", r"isc"),
    ("zlib", r"zlib"),
    ("bsd-0", r"0bsd"),
    ("bsd-2", r"bsd-2-clause"),
    ("bsd-3", r"bsd-3-clause"),
    ("bsd-4", r"bsd-4-clause"),
    ("gpl-1", r"gpl-1\.0(?:\+|-only|-or-later)?"),
    ("gpl-2", r"gpl-2\.0(?:\+|-only|-or-later)?"),
    ("gpl-3", r"gpl-3\.0(?:\+|-only|-or-later)?"),
    ("lgpl-2", r"lgpl-2\.[01](?:\+|-only|-or-later)?"),
    ("lgpl-3", r"lgpl-3\.0(?:\+|-only|-or-later)?"),
    ("agpl-3", r"agpl-3\.0(?:\+|-only|-or-later)?"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("mpl-1.1", r"mpl-1\.1"),
    ("mpl-2.0", r"mpl-2\.0(?:-no-copyleft-exception)?"),
    ("epl-1.0", r"epl-1\.0"),
    ("epl-2.0", r"epl-2\.0"),
    ("cddl", r"cddl-1\.[01]"),
    ("cpl", r"cpl-1\.0"),
    ("artistic-1", r"artistic-1\.0(?:-cl8|-perl)?"),
    ("artistic-2", r"artistic-2\.0"),
    ("boost", r"bsl-1\.0"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("python", r"(?:psf-2\.0|python-2\.0(?:\.1)?)"),
    ("php", r"php-3\.01?"),
    ("ruby", r"ruby"),
    ("openssl", r"openssl"),
    ("eupl", r"eupl-1\.[012]"),
    ("ofl", r"ofl-1\.[01](?:-no-rfn|-rfn)?"),
    ("odbl", r"odbl-1\.0"),
    ("odc-by", r"odc-by-1\.0"),
    ("cc0", r"cc0-1\.0"),
    ("cc-by", r"cc-by-(?:[134]\.0|2\.[05])"),
    ("cc-by-sa", r"cc-by-sa-(?:[134]\.0|2\.[05])"),
    ("cc-by-nc", r"cc-by-nc-(?:[134]\.0|2\.[05])"),
    ("cc-by-nd", r"cc-by-nd-(?:[134]\.0|2\.[05])"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-(?:[134]\.0|2\.[05])"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-(?:[134]\.0|2\.[05])"),
]
SPDX_FORM = (45, 0.95, r"spdx-license-identifier:?[\s(]*(?:[-+.0-9a-z]+[\s)]+(?:and|or|with)[\s(]+)*(?P<at>NAME)(?![-+.]?[0-9a-z])")

# Forms: priority, relevance, pattern with the name in the place of NAME.
FORMS = [
    (60, 1.00, r"(?:this|the) (?:work|text|page|file|program|software|document|content|article|dataset) is (?:licensed|released|distributed|available|published) (?:under|with) (?:the )?(?:terms of )?(?:the |an? )?NAME"),
    (50, 0.95, r"(?:licensed|released|distributed|available|published) (?:under|with) (?:the )?(?:terms of )?(?:the |an? )?NAME"),
    (45, 0.95, r"spdx-license-identifier:? ?NAME"),
    (40, 0.90, r"(?:license|licence) ?: ?(?:the )?NAME"),
    (30, 0.80, r"(?:under|subject to) (?:the )?(?:terms of )?(?:the )?NAME"),
    (10, 0.60, r"NAME"),
]

# Signatures, written one by one: label, keyword, priority, relevance, pattern. What the group "at" matches is detected; without it, nothing.
SIGNATURES = [
    # reservations, copyright lines and refusals
    ("reserved", "reserved", 20, 0.70, r"all rights reserved"),
    ("reserved", "reserved", 20, 0.70, r"all rights are reserved"),
    ("reserved", "reserved", 22, 0.75, r"all other rights (?:are )?reserved"),
    ("reserved", "reserved", 18, 0.60, r"some rights reserved"),
    ("reserved", "reservados", 20, 0.70, r"(?:todos los )?derechos reservados"),
    ("reserved", "vorbehalten", 20, 0.70, r"alle rechte vorbehalten"),
    ("reserved", "droits", 20, 0.70, r"tous droits r\S{1,2}serv\S{1,2}s"),
    ("reserved", "copyright", 35, 0.85, r"copyright(?: \(c\)| ©)? ?(?:19|20)[0-9]{2}(?s:.){0,80}?all rights reserved"),
    ("copyright", "copyright", 15, 0.40, r"copyright(?: \(c\)| ©)? ?(?:19|20)[0-9]{2}"),
    ("copyright", "copyright", 14, 0.35, r"copyright (?:holder|owner|notice)s?"),
    ("copyright", "copyright", 16, 0.40, r"protected by (?:international )?copyright(?: laws?)?"),
    ("proprietary", "proprietary", 25, 0.70, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "information", 25, 0.70, r"contains? (?:confidential|proprietary) information of"),
    ("proprietary", "secret", 25, 0.70, r"trade secrets? of"),
    ("proprietary", "prohibited", 25, 0.70, r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: or (?:copying|use|reproduction|distribution))? (?:of this \S+ )?is (?:strictly )?prohibited"),
    ("proprietary", "disclosure", 25, 0.70, r"(?:terms|subject) (?:of|to) (?:a|the) (?:non-?disclosure|nondisclosure) agreement|nondisclosure agreement"),
    ("proprietary", "internal", 22, 0.60, r"for internal use only"),
    ("no-reuse", "permission", 25, 0.70, r"(?:may not be|do not) (?:reproduced|copied|reproduce|copy)(?s:.){0,60}without (?:prior )?(?:written )?permission"),
    ("no-reuse", "part", 25, 0.70, r"no part of this (?:publication|book|document|work) may be (?:reproduced|copied|stored)"),
    ("no-reuse", "not", 24, 0.70, r"(?:may|must|shall) not be (?:rewritten or )?(?:redistributed|republished|rebroadcast)"),
    ("no-reuse", "commercial", 22, 0.60, r"for (?:personal|private),? (?:and )?non-?commercial use only"),
    ("no-reuse", "commercial", 22, 0.60, r"not for commercial (?:use|purposes|distribution)"),
    ("no-reuse", "evaluation", 22, 0.60, r"for evaluation purposes only"),
    # MIT and its relatives
    ("mit", "permission", 55, 0.98, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "permission", 54, 0.95, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "restriction", 53, 0.90, r"to deal in the software without restriction"),
    ("mit", "sublicense", 53, 0.90, r"rights to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies"),
    ("mit", "warranty", 40, 0.70, r"the software is provided \W?as is\W?, without warranty of any kind, express or implied"),
    ("mit", "license", 42, 0.90, r"mit license \(mit\)"),
    ("mit", "opensource.org", 44, 0.90, r"opensource\.org/licenses/mit(?:-license(?:\.php)?)?"),
    ("mit", "expat", 30, 0.80, r"expat license"),
    ("mit-0", "attribution", 46, 0.90, r"mit no attribution"),
    ("x11", "consortium", 50, 0.95, r"the name of the x consortium shall not be used"),
    ("x11", "consortium", 46, 0.90, r"in no event shall the x consortium be liable"),
    ("isc", "permission", 55, 0.98, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", 54, 0.95, r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", 44, 0.80, r"the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission", 52, 0.95, r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("ntp", "permission", 51, 0.90, r"provided that the above copyright notice appears? in all copies and that both (?:that|the) copyright notice and this permission notice appear"),
    ("bsd-0", "0bsd", 44, 0.90, r"0bsd"),
    # BSD
    ("bsd", "redistribution", 55, 0.98, r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "redistributions", 52, 0.95, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 52, 0.95, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", 53, 0.95, r"neither the names? of (?s:.){1,80}?(?:may|will|shall) be used to endorse or promote products"),
    ("bsd-3", "endorse", 50, 0.90, r"the names? of the (?:authors?|copyright holders?|contributors?) may not be used to endorse or promote products"),
    ("bsd-4", "advertising", 54, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "software", 42, 0.80, r"this software is provided by the (?:copyright holders?|authors?|regents)(?: and contributors)? \W{0,2}as is"),
    ("bsd", "regents", 40, 0.80, r"the regents of the university of california"),
    ("bsd", "consequential", 36, 0.60, r"be liable for any direct, indirect, incidental, special, exemplary, or consequential damages"),
    ("bsd", "bsd", 20, 0.70, r"bsd[- ]licensed"),
    ("bsd-2", "opensource.org", 44, 0.90, r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3", "opensource.org", 44, 0.90, r"opensource\.org/licenses/bsd-3-clause"),
    # Apache
    ("apache-2.0", "apache", 55, 0.98, r"you may not use this file except in compliance with the license(?s:.){0,200}apache"),
    ("apache-2.0", "apache.org", 54, 0.95, r"apache\.org/licenses/license-2\.0(?:\.txt|\.html)?"),
    ("apache-2.0", "contributor", 50, 0.90, r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", "license", 46, 0.85, r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "required", 44, 0.80, r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \W?as is\W? basis"),
    ("apache-2.0", "derivative", 44, 0.85, r"a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works"),
    ("apache-2.0", "conditions", 46, 0.90, r"terms and conditions for use, reproduction, and distribution"),
    ("apache-1.1", "foundation", 52, 0.95, r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", 52, 0.95, r"this product includes software developed by the apache group"),
    ("apache", "apache", 20, 0.70, r"apache[- ]licensed"),
    # GNU
    ("gpl", "redistribute", 55, 0.98, r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 56, 0.98, r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "redistribute", 56, 0.98, r"you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("gpl-2", "version", 57, 0.98, r"gnu general public license(?: as published by the free software foundation)?[;,] (?:either )?version 2(?: of the license)?,? (?:or \(at your option\) any later version)"),
    ("gpl-3", "version", 57, 0.98, r"gnu general public license(?: as published by the free software foundation)?[;,] (?:either )?version 3(?: of the license)?,? (?:or \(at your option\) any later version)"),
    ("gpl", "general", 12, 0.60, r"(?:lesser|affero|library) general public license|(?P<at>general public license)"),
    ("gpl", "merchantability", 40, 0.75, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", 46, 0.90, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received", 47, 0.90, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "received", 47, 0.90, r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "gnu.org", 44, 0.90, r"gnu\.org/(?:licenses|copyleft)/gpl(?:-[123]\.0)?(?:\.html|\.txt)?"),
    ("lgpl", "gnu.org", 44, 0.90, r"gnu\.org/(?:licenses|copyleft)/lgpl(?:-[23]\.[01])?(?:\.html|\.txt)?"),
    ("agpl-3", "gnu.org", 44, 0.90, r"gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?"),
    ("gfdl", "gnu.org", 44, 0.90, r"gnu\.org/(?:licenses|copyleft)/fdl(?:-1\.[123])?(?:\.html|\.txt)?"),
    ("gpl", "copyleft", 30, 0.60, r"copyleft license"),
    ("gpl", "verbatim", 42, 0.85, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "freedom", 46, 0.90, r"licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "absolutely", 40, 0.75, r"comes with absolutely no warranty"),
    ("gpl", "dual", 32, 0.75, r"dual[- ]licensed under (?:the )?(?:terms of )?(?:the )?(?:mit|bsd|apache)(?: license)? (?:and|or) (?:the )?(?:gnu )?l?gpl"),
    ("gpl", "exception", 44, 0.80, r"as a special exception, (?:the copyright holders?|the authors?|you may)"),
    ("lgpl", "classpath", 46, 0.85, r"classpath exception"),
    ("gfdl", "invariant", 52, 0.95, r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", "documentation", 50, 0.95, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2.0", "mozilla", 55, 0.98, r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", "mozilla", 55, 0.98, r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.1", "mozilla", 56, 0.98, r"version: mpl 1\.1/gpl 2\.0/lgpl 2\.1(?s:.){0,400}?mozilla"),
    ("mpl", "mozilla.org", 44, 0.90, r"mozilla\.org/mpl(?:/[12]\.[01])?"),
    ("mpl", "software", 40, 0.80, r"distribution of covered software"),
    ("epl-1.0", "eclipse.org", 54, 0.95, r"eclipse\.org/legal/epl-v10(?:\.html)?"),
    ("epl-2.0", "eclipse.org", 54, 0.95, r"eclipse\.org/legal/epl-(?:v20|2\.0)(?:\.html)?"),
    ("epl-1.0", "accompanying", 56, 0.95, r"the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "accompanying", 56, 0.95, r"the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2\.0"),
    ("edl", "eclipse", 46, 0.90, r"eclipse distribution license(?: -)? v ?1\.0"),
    ("cddl", "cddl", 54, 0.95, r"the contents of this file are subject to the terms of the common development and distribution license(?s:.){0,200}?cddl"),
    ("cpl", "public", 46, 0.90, r"ibm public license"),
    ("cpl", "recipient's", 50, 0.90, r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("osl", "software", 46, 0.90, r"open software license(?:,? (?:version |v\. ?)?[123]\.[01])?"),
    ("afl", "academic", 46, 0.90, r"academic free license(?:,? (?:version |v\. ?)?[123]\.[01])?"),
    ("apsl", "public", 46, 0.90, r"apple public source license"),
    ("npl", "netscape", 46, 0.90, r"netscape public license"),
    ("qpl", "public", 46, 0.90, r"q public license"),
    ("eupl", "eupl", 54, 0.95, r"licensed under the eupl(?:,? version 1\.[012])?"),
    ("cecill", "cecill", 46, 0.90, r"cecill(?:-[bc])?(?: free software)? licen[cs]e"),
    ("cecill", "cecill.info", 46, 0.90, r"cecill\.info"),
    ("ms-pl", "microsoft", 46, 0.90, r"microsoft public license(?: \(ms-pl\))?"),
    ("ms-rl", "reciprocal", 46, 0.90, r"microsoft reciprocal license(?: \(ms-rl\))?"),
    # permissive ones with sentences of their own
    ("zlib", "altered", 55, 0.98, r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", 52, 0.90, r"the origin of this software must not be misrepresented"),
    ("zlib", "freely", 52, 0.90, r"to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("libpng", "libpng", 46, 0.90, r"(?:the )?libpng license"),
    ("ijg", "independent", 46, 0.85, r"this software is based in part on the work of the independent jpeg group"),
    ("boost", "boost", 55, 0.98, r"distributed under the boost software license, version 1\.0"),
    ("boost", "boost.org", 46, 0.90, r"boost\.org/license_1_0\.txt"),
    ("artistic-2", "artistic", 46, 0.90, r"perlfoundation\.org/artistic_license_2_0|the artistic license 2\.0"),
    ("artistic", "itself", 50, 0.90, r"under the same terms as perl(?: [0-9.]+)? itself|same terms as perl itself"),
    ("openssl", "openssl", 54, 0.95, r"this product includes software developed by the openssl project"),
    ("openssl", "young", 50, 0.90, r"this product includes cryptographic software written by eric young"),
    ("php", "php", 54, 0.95, r"this source file is subject to version [23]\.0[0-9]? of the php license"),
    ("php", "php.net", 46, 0.90, r"php\.net/license/[23]_0[0-9]?\.txt"),
    ("python", "psf", 48, 0.90, r"psf license agreement for python"),
    ("python", "beopen", 48, 0.90, r"beopen\.com license agreement for python"),
    ("python", "cnri", 48, 0.90, r"cnri license agreement"),
    ("ruby", "ruby's", 46, 0.85, r"distributed under (?:the same terms as )?ruby's license"),
    ("vim", "license", 46, 0.90, r"vim license"),
    ("tcl", "tcl", 46, 0.85, r"tcl/tk license"),
    ("curl", "license", 46, 0.90, r"curl license"),
    ("postgresql", "postgresql", 46, 0.90, r"postgresql licen[cs]e"),
    ("ncsa", "university", 50, 0.95, r"university of illinois/ncsa open source license"),
    ("w3c", "w3c", 46, 0.90, r"w3c(?:\S{0,2})? software (?:notice and )?license"),
    ("unicode", "unicode", 46, 0.90, r"unicode(?:, inc\.)? license agreement"),
    ("ofl", "reserved", 52, 0.95, r"with reserved font names?"),
    ("ofl", "scripts.sil.org", 46, 0.90, r"scripts\.sil\.org/ofl"),
    ("bitstream-vera", "bitstream", 46, 0.90, r"bitstream vera is a trademark of bitstream"),
    ("beerware", "beer", 50, 0.95, r"you can buy me a beer in return"),
    ("beerware", "beer", 44, 0.90, r"beerware license|the beer-?ware license"),
    ("wtfpl", "what", 52, 0.95, r"do what the f\S{1,3} you want to public license"),
    ("jslint", "good,", 52, 0.95, r"the software shall be used for good, not evil"),
    ("unlicense", "unencumbered", 55, 0.98, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense.org", 46, 0.90, r"unlicense\.org"),
    ("public-domain", "public", 30, 0.75, r"(?:dedicate|place|release)[sd]? (?:\S+ ){1,8}?(?:in|into|to) the public domain"),
    ("public-domain", "public", 24, 0.65, r"is (?:a )?public domain(?: work)?"),
    ("public-domain", "disclaims", 50, 0.95, r"the author disclaims copyright to this source code"),
    ("public-domain", "copyright", 30, 0.75, r"no known copyright restrictions"),
    ("public-domain", "government", 30, 0.75, r"a work of the u\.s\. government"),
    # Creative Commons and data
    ("cc0", "deed", 46, 0.85, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "creativecommons.org", 52, 0.95, r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "creativecommons.org", 52, 0.95, r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by/(?:[134]\.0|2\.[05])"),
    ("cc-by-sa", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by-sa/(?:[134]\.0|2\.[05])"),
    ("cc-by-nc", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by-nc/(?:[134]\.0|2\.[05])"),
    ("cc-by-nd", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by-nd/(?:[134]\.0|2\.[05])"),
    ("cc-by-nc-sa", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by-nc-sa/(?:[134]\.0|2\.[05])"),
    ("cc-by-nc-nd", "creativecommons.org", 52, 0.95, r"creativecommons\.org/licenses/by-nc-nd/(?:[134]\.0|2\.[05])"),
    ("cc", "share", 40, 0.70, r"you are free to share(?: and adapt)?(?: the material)?"),
    ("cc", "appropriate", 40, 0.70, r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", "sharealike", 42, 0.80, r"attribution[- ]sharealike"),
    ("cc-by-nc", "noncommercial", 41, 0.75, r"attribution[- ]noncommercial"),
    ("cc-by-sa", "license", 38, 0.70, r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial", 36, 0.60, r"you may not use the material for commercial purposes"),
    ("odbl", "opendatacommons.org", 52, 0.95, r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons.org", 52, 0.95, r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons.org", 52, 0.95, r"opendatacommons\.org/licenses/pddl"),
    ("pddl", "dedication", 46, 0.85, r"public domain dedication and licen[cs]e"),
    ("cdla", "community", 46, 0.90, r"community data license agreement(?:,? (?:permissive|sharing))?"),
    ("ogl", "government", 46, 0.90, r"open government licen[cs]e(?: v[123]\.0)?"),
    ("etalab", "etalab", 46, 0.90, r"licence ouverte(?: /)? ?(?:open licence )?etalab|etalab open licence"),
    # source-available and model licenses
    ("bsl-1.1", "business", 46, 0.90, r"business source license(?: 1\.1)?"),
    ("sspl", "server", 46, 0.90, r"server side public license"),
    ("elastic", "elastic", 46, 0.90, r"elastic license(?: 2\.0)?"),
    ("commons-clause", "commons", 46, 0.90, r"commons clause(?: license condition)?"),
    ("polyform", "polyform", 46, 0.90, r"polyform (?:noncommercial|small business|shield|strict) license"),
    ("rail", "responsible", 46, 0.90, r"responsible ai license"),
    ("rail", "openrail", 46, 0.90, r"openrail(?:-m|\+\+)?"),
    # software end-user terms
    ("eula", "license", 42, 0.85, r"end user license agreement"),
    ("eula", "end-user", 42, 0.85, r"end-user license agreement"),
    ("eula", "engineer", 36, 0.70, r"(?:may|shall|must) not (?:\S+ ){0,6}?reverse[- ]engineer"),
    ("eula", "non-transferable", 36, 0.70, r"(?:limited, )?non-exclusive,? (?:and )?non-transferable (?:\S+ ){0,3}?licen[cs]e"),
    ("eula", "installing", 36, 0.70, r"by installing(?:,| or using| and using) (?:\S+ ){0,6}?you agree"),
    ("freeware", "freeware", 26, 0.60, r"is (?:distributed as )?freeware"),
    ("shareware", "shareware", 26, 0.60, r"is (?:distributed as )?shareware"),
    ("terms", "terms", 18, 0.40, r"terms of (?:use|service) apply|(?:subject to|governed by) (?:the |our )?terms of use"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    relevance: float
    pattern: re.Pattern
    core: re.Pattern


def spaced(pattern: str) -> str:
    """The pattern with any white space where a table's pattern has a blank."""
    for blank, wide in (("[- ]", r"(?:-|\s+)"), (" ?", r"\s*"), (" ", r"\s+")):
        pattern = pattern.replace(blank, wide)
    return pattern


def rules() -> list[Rule]:
    """All rules, by priority."""
    edge = lambda p: re.compile(rf"(?<![0-9a-z\x80-\U0010ffff])(?:{p})(?![0-9a-z\x80-\U0010ffff])")
    rank = lambda priority, label: priority + any(c.isdigit() for c in label)
    made = [Rule(label, word, rank(priority, label), relevance, edge(spaced(form.replace("NAME", name))), re.compile(spaced(name))) for label, word, name in NAMES for priority, relevance, form in FORMS]
    priority, relevance, form = SPDX_FORM
    made += [Rule(label, "spdx-license-identifier", rank(priority, label), relevance, edge(form.replace("NAME", name)), re.compile(name)) for label, name in SPDX]
    made += [Rule(label, word, priority, relevance, edge(spaced(p)), re.compile(spaced(p))) for label, word, priority, relevance, p in SIGNATURES]
    return sorted(made, key=lambda r: -r.priority)


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    relevance: float


def resolve(found: list[Detection]) -> list[Detection]:
    """What stays of overlapping detections: best priority first, then the longest, then the leftmost; none inside another.

    A tree over the sorted starts keeps the furthest end taken up to each start, so
    that n detections take n log n steps.
    """
    starts = sorted({d.start for d in found})
    slot = {start: k + 1 for k, start in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    taken: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        k, end = slot[d.start], -1
        while k:
            end = max(end, furthest[k])
            k &= k - 1
        if end >= d.end:
            continue
        taken.append(d)
        k = slot[d.start]
        while k <= len(starts):
            furthest[k] = max(furthest[k], d.end)
            k += k & -k
    return sorted(taken, key=lambda d: (d.start, d.end))


def detect(text: str, candidates: list[Rule]) -> list[Detection]:
    """Detections in a text whose A-Z are lower case already."""
    found = []
    for r in candidates:
        group = r.pattern.groupindex.get("at", 0)
        found += [Detection(r.label, *m.span(group), r.priority, r.relevance) for m in r.pattern.finditer(text) if m[group] is not None]
    return resolve(found)


def word_hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return T.Words(T.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), T.ALNUM_SEP, lower=True).hashes()


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.gates: dict[bytes, dict[re.Pattern, list[Rule]]] = {}
        for r in self.rules:
            self.gates.setdefault(r.keyword.encode(), {}).setdefault(r.core, []).append(r)
        self.base = [(word_hashes(p.split()), label) for p, label in BASE.items()]

    def find(self, raw: bytes) -> list[Detection]:
        """Detections in a text whose A-Z are lower case already: the same as of detect() with all rules."""
        cores = [x for keyword, x in self.gates.items() if keyword in raw]
        if not cores:
            return []
        text = raw.decode("utf-8", "replace")
        return detect(text, [r for x in cores for core, same in x.items() if core.search(text) for r in same])

    def scan(self, t: T.Texts) -> dict:
        n = len(t)
        w = T.Words(t, T.ALNUM_SEP, lower=True)
        words = w.hashes()
        places, labels = [], [set() for _ in range(n)]
        for phrase, label in self.base:
            at = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0]) if len(words) >= len(phrase) else np.empty(0, np.int64)
            for k in range(1, len(phrase)):
                at = at[words[at + k] == phrase[k]]
            at = at[w.doc[at] == w.doc[at + len(phrase) - 1]]
            places.append(at)
            for d in np.unique(w.doc[at]).tolist():
                labels[d].add(label)
        at = np.sort(np.concatenate(places))
        doc = w.doc[at]
        n_base = np.bincount(doc, minlength=n)
        rel = at - w.first[doc]
        first, last = np.full(n, -1), np.full(n, -1)
        first[doc[::-1]] = rel[::-1]
        last[doc] = rel
        lower = T.Texts(w.data, t.offs)
        found = [self.find(lower.raw(i)) for i in range(n)]
        joined = [",".join(sorted(base | {x.label for x in det})) for base, det in zip(labels, found, strict=True)]
        score = [max([0.5 * bool(base), *(x.relevance for x in det)]) for base, det in zip(labels, found, strict=True)]
        none = n_base == 0
        return {
            "n_words": np.diff(w.first),
            "n_base": n_base,
            "first_word": pa.array(first, pa.int64(), mask=none),
            "last_word": pa.array(last, pa.int64(), mask=none),
            "base_labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
            "labels": pa.array(joined, pa.string()),
            "score": pa.array(score, pa.float64()),
            "detections": pa.array([[{"label": x.label, "start": x.start, "end": x.end, "relevance": x.relevance} for x in det] for det in found], _DETECTIONS),
        }


_DETECTIONS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("relevance", pa.float64())]))
SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,start:bigint,end:bigint,relevance:double>>"
_scanner: list[Scanner] = []


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels, score and detections (with character positions) of every row."""

    def make(t: T.Texts) -> dict:
        if not _scanner:
            _scanner.append(Scanner())
        return _scanner[0].scan(t)

    return T.per_row(df, [text_col], SCHEMA, make, [id_col])
