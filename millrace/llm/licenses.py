"""License scans by ordered signature rules.

A text becomes a string of words with one space between them, and the hand-written
patterns are tried on it, each only if its keyword occurs. Detections are
taken in order of priority, then length, then place; one that lies inside an
interval already taken is suppressed, so that `apache license version 2 0` does
not also report the bare name in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table, ship_by_value, worker_cache

# The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: The rules, in order: priority, label, keyword that every match holds, pattern over words with one space between them.
#: A longer name stands above the shorter one in it, and a sentence of a license text above its name.
RULES = (
    # Identifiers that stand alone
    (36, "apache-2.0", "apache 2 0", r"apache 2 0"),
    (35, "mit", "mit", r"(?:apache 2 0|bsd 3 clause|gpl [23] 0(?: only| or later)?) (?:or|and) mit"),
    # MIT and relatives
    (95, "mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (94, "mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (92, "mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (80, "mit", "mit", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?mit(?: x11| expat)?(?: style)? licen[cs]e"),
    (78, "mit", "mit", r"(?:licensed|released) under (?:the terms of )?mit"),
    (78, "mit", "mit", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit (?:terms|x11|expat)"),
    (60, "mit", "mit", r"spdx license identifier (?:[a-z0-9]+ ){1,8}(?:or|and) mit"),
    (76, "mit", "mit", r"(?:this (?:project|software|code|library|package|work) is )mit licensed"),
    (74, "mit", "mit", r"dual licensed under (?:the )?mit"),
    (70, "mit", "licenses mit", r"opensource org licenses mit(?: license(?: php| html)?)?"),
    (68, "mit", "mit", r"spdx license identifier mit"),
    (50, "mit", "mit", r"license mit"),
    (48, "mit", "mit", r"the mit licen[cs]e(?: mit)?"),
    (46, "mit", "mit", r"mit x11 licen[cs]e"),
    (44, "mit", "expat", r"expat licen[cs]e"),
    (42, "mit", "mit", r"mit style licen[cs]e"),
    (40, "mit", "mit", r"mit licen[cs]e"),
    (41, "mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    (69, "mit-0", "mit 0", r"spdx license identifier mit 0"),
    (40, "x11", "x11", r"x11 licen[cs]e"),
    # Apache
    (95, "apache-2.0", "in compliance with the license", r"you may not use this (?:file|work|software) except in compliance with the license"),
    (94, "apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (82, "apache-2.0", "apache", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    (81, "apache-2.0", "apache", r"(?:licensed|released|distributed|available) under (?:the )?apache 2(?: 0)?(?: licen[cs]e)?"),
    (72, "apache-2.0", "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    (70, "apache-2.0", "apache", r"opensource org licenses apache 2 0"),
    (68, "apache-2.0", "apache 2 0", r"spdx license identifier apache 2 0"),
    (52, "apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |ver |v ?)?2(?: 0)?"),
    (51, "apache-2.0", "apache", r"apache (?:version |v )?2(?: 0)? licen[cs]e"),
    (50, "apache-2.0", "apache v2", r"apache v2(?: 0)?(?: licen[cs]e)?"),
    (49, "apache-2.0", "asl 2", r"asl 2 0"),
    (52, "apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    (52, "apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 0"),
    (60, "apache", "apache", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[cs]e"),
    (42, "apache", "apache software foundation", r"licensed to the apache software foundation"),
    (40, "apache", "apache", r"apache (?:software )?licen[cs]e"),
    # GNU GPL
    (96, "gpl-2.0-or-later", "either version 2", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (96, "gpl-3.0-or-later", "either version 3", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (94, "gpl", "free software", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (90, "gpl", "general public license for more details", r"see the gnu general public license for more details"),
    (88, "gpl", "copy of the gnu general public", r"you should have received a copy of the gnu general public license"),
    (82, "gpl-2.0", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license (?:version |ver |v ?)?2(?: 0)?"),
    (82, "gpl-3.0", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license (?:version |ver |v ?)?3(?: 0)?"),
    (81, "gpl-2.0", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |ver |v ?)?2(?: 0)?"),
    (81, "gpl-3.0", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |ver |v ?)?3(?: 0)?"),
    (69, "gpl-2.0-only", "gpl 2 0", r"spdx license identifier gpl 2 0(?: only)?"),
    (70, "gpl-2.0-or-later", "gpl 2 0 or later", r"spdx license identifier gpl 2 0 or later"),
    (69, "gpl-3.0-only", "gpl 3 0", r"spdx license identifier gpl 3 0(?: only)?"),
    (70, "gpl-3.0-or-later", "gpl 3 0 or later", r"spdx license identifier gpl 3 0 or later"),
    (66, "gpl-2.0", "gnu org licenses", r"gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    (66, "gpl-3.0", "gnu org licenses", r"gnu org licenses gpl 3 0(?: html| txt)?"),
    (64, "gpl", "gnu org licenses", r"gnu org licenses gpl(?: html| txt)?"),
    (56, "gpl-2.0-or-later", "general public", r"(?:gnu )?general public license (?:version |ver |v ?)?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    (56, "gpl-3.0-or-later", "general public", r"(?:gnu )?general public license (?:version |ver |v ?)?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    (54, "gpl-1.0", "general public", r"(?:gnu )?general public license (?:version |ver |v ?)?1(?: 0)?"),
    (54, "gpl-2.0", "general public", r"(?:gnu )?general public license (?:version |ver |v ?)?2(?: 0)?"),
    (54, "gpl-3.0", "general public", r"(?:gnu )?general public license (?:version |ver |v ?)?3(?: 0)?"),
    (54, "gpl-2.0", "general public", r"(?:gnu )?general public license v2(?: 0)?"),
    (54, "gpl-3.0", "general public", r"(?:gnu )?general public license v3(?: 0)?"),
    (53, "gpl-2.0", "version 2", r"version 2 of the (?:gnu )?(?:general public license|gpl)"),
    (53, "gpl-3.0", "version 3", r"version 3 of the (?:gnu )?(?:general public license|gpl)"),
    (52, "gpl-2.0-or-later", "gpl 2", r"gpl 2 0 or later"),
    (52, "gpl-2.0-only", "gpl 2 0 only", r"gpl 2 0 only"),
    (52, "gpl-3.0-only", "gpl 3 0 only", r"gpl 3 0 only"),
    (49, "gpl-2.0", "gpl 2 0", r"gpl 2 0"),
    (49, "gpl-3.0", "gpl 3 0", r"gpl 3 0"),
    (52, "gpl-3.0-or-later", "gpl 3", r"gpl 3 0 or later"),
    (51, "gpl-2.0", "gpl v2", r"(?:gnu )?gpl v2(?: 0)?"),
    (51, "gpl-3.0", "gpl v3", r"(?:gnu )?gpl v3(?: 0)?"),
    (51, "gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    (51, "gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    (50, "gpl-2.0", "gpl", r"gnu gpl (?:version |ver )?2(?: 0)?"),
    (50, "gpl-3.0", "gpl", r"gnu gpl (?:version |ver )?3(?: 0)?"),
    (50, "gpl-2.0", "gpl", r"gpl (?:version |ver )2(?: 0)?"),
    (50, "gpl-3.0", "gpl", r"gpl (?:version |ver )3(?: 0)?"),
    (45, "gpl", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    (44, "gpl", "license gpl", r"license gpl"),
    (43, "gpl", "gpl licen", r"(?:gnu )?gpl licen[cs]ed?"),
    (42, "gpl", "gnu gpl", r"gnu gpl"),
    (40, "gpl", "general public license", r"(?:gnu )?general public license"),
    # GNU LGPL
    (94, "lgpl", "lesser general public", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (94, "lgpl", "library general public", r"is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    (70, "lgpl-2.1-only", "lgpl 2 1", r"spdx license identifier lgpl 2 1(?: only)?"),
    (71, "lgpl-2.1-or-later", "lgpl 2 1 or later", r"spdx license identifier lgpl 2 1 or later"),
    (70, "lgpl-3.0-only", "lgpl 3 0", r"spdx license identifier lgpl 3 0(?: only)?"),
    (71, "lgpl-3.0-or-later", "lgpl 3 0 or later", r"spdx license identifier lgpl 3 0 or later"),
    (57, "lgpl-2.1-or-later", "lesser general", r"(?:gnu )?lesser general public license (?:version |ver |v ?)?2 1 or (?:at your option )?(?:any )?later(?: version)?"),
    (57, "lgpl-3.0-or-later", "lesser general", r"(?:gnu )?lesser general public license (?:version |ver |v ?)?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    (56, "lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license (?:version |ver |v ?)?2 1"),
    (56, "lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license (?:version |ver |v ?)?3(?: 0)?"),
    (56, "lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license v3(?: 0)?"),
    (56, "lgpl-2.0", "library general", r"(?:gnu )?library general public license (?:version |ver |v ?)?2(?: 0)?"),
    (56, "lgpl-2.0", "lesser general", r"(?:gnu )?lesser general public license (?:version |ver |v ?)?2(?: 0)?"),
    (54, "lgpl-2.1-or-later", "lgpl 2 1 or later", r"lgpl 2 1 or later"),
    (54, "lgpl-2.1-only", "lgpl 2 1 only", r"lgpl 2 1 only"),
    (54, "lgpl-3.0-or-later", "lgpl 3 0 or later", r"lgpl 3 0 or later"),
    (54, "lgpl-3.0-only", "lgpl 3 0 only", r"lgpl 3 0 only"),
    (53, "lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version |ver |v ?)?2 1"),
    (53, "lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:version |ver |v ?)?3(?: 0)?"),
    (52, "lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?"),
    (52, "lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: )?v3"),
    (45, "lgpl", "lgpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"),
    (44, "lgpl", "gnu lgpl", r"gnu lgpl"),
    (44, "lgpl", "license lgpl", r"license lgpl"),
    (43, "lgpl", "lesser general public", r"(?:gnu )?lesser general public license"),
    (43, "lgpl", "library general public", r"(?:gnu )?library general public license"),
    # GNU AGPL and documentation licenses
    (95, "agpl-3.0", "affero general public", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (70, "agpl-3.0-only", "agpl 3 0", r"spdx license identifier agpl 3 0(?: only)?"),
    (71, "agpl-3.0-or-later", "agpl 3 0 or later", r"spdx license identifier agpl 3 0 or later"),
    (57, "agpl-3.0", "affero general", r"(?:gnu )?affero general public license (?:version |ver |v ?)?3(?: 0)?"),
    (57, "agpl-3.0", "affero general", r"(?:gnu )?affero general public license v3"),
    (58, "agpl-3.0-or-later", "affero general", r"(?:gnu )?affero general public license (?:version |ver |v ?)?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    (57, "lgpl-2.1", "library general", r"(?:gnu )?library general public license (?:version |ver |v ?)?2 1(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
    (57, "agpl-1.0", "affero general", r"(?:gnu )?affero general public license (?:version |ver |v ?)?1(?: 0)?"),
    (54, "agpl-3.0-or-later", "agpl 3 0 or later", r"agpl 3 0 or later"),
    (54, "agpl-3.0-only", "agpl 3 0 only", r"agpl 3 0 only"),
    (52, "agpl-3.0", "agpl", r"(?:gnu )?agpl (?:version |ver |v ?)?3(?: 0)?"),
    (52, "agpl-3.0", "agpl", r"(?:gnu )?agpl(?: )?v3"),
    (46, "agpl", "affero general public", r"(?:gnu )?affero general public license"),
    (44, "agpl", "gnu agpl", r"gnu agpl"),
    (80, "gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (54, "gfdl-1.2", "free documentation", r"(?:gnu )?free documentation license (?:version |v )?1 2"),
    (54, "gfdl-1.3", "free documentation", r"(?:gnu )?free documentation license (?:version |v )?1 3"),
    (44, "gfdl", "free documentation", r"(?:gnu )?free documentation license"),
    (43, "gfdl", "gfdl", r"(?:gnu )?gfdl(?: 1 [123])?"),
    # BSD
    (95, "bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (96, "bsd-3-clause", "endorse or promote", r"neither the name of (?:[^ ]+ ){1,14}may be used to endorse or promote products derived from this software"),
    (96, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    (90, "bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice"),
    (90, "bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    (70, "bsd-2-clause", "bsd 2 clause", r"spdx license identifier bsd 2 clause"),
    (70, "bsd-3-clause", "bsd 3 clause", r"spdx license identifier bsd 3 clause"),
    (70, "bsd-4-clause", "bsd 4 clause", r"spdx license identifier bsd 4 clause"),
    (70, "0bsd", "0bsd", r"spdx license identifier 0bsd"),
    (66, "bsd-2-clause", "opensource org", r"opensource org licenses bsd 2 clause"),
    (66, "bsd-3-clause", "opensource org", r"opensource org licenses bsd 3 clause"),
    (55, "bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: simplified)?(?: licen[cs]e)?"),
    (55, "bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: new| revised)?(?: licen[cs]e)?"),
    (55, "bsd-4-clause", "bsd", r"bsd (?:4|four) clause(?: licen[cs]e)?"),
    (55, "bsd-2-clause", "clause bsd", r"(?:2|two) clause bsd(?: style)?(?: licen[cs]e)?"),
    (55, "bsd-3-clause", "clause bsd", r"(?:3|three) clause bsd(?: style)?(?: licen[cs]e)?"),
    (55, "bsd-4-clause", "clause bsd", r"(?:4|four) clause bsd(?: style)?(?: licen[cs]e)?"),
    (54, "bsd-2-clause", "simplified bsd", r"simplified bsd licen[cs]e"),
    (54, "bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    (54, "bsd-3-clause", "new bsd", r"new bsd licen[cs]e"),
    (54, "bsd-3-clause", "modified bsd", r"modified bsd licen[cs]e"),
    (54, "bsd-3-clause", "revised bsd", r"revised bsd licen[cs]e"),
    (54, "bsd-4-clause", "original bsd", r"original bsd licen[cs]e"),
    (54, "0bsd", "zero clause bsd", r"zero clause bsd(?: licen[cs]e)?"),
    (52, "bsd", "bsd", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style| like)?(?: licen[cs]e)?"),
    (42, "bsd", "bsd style", r"bsd style(?: licen[cs]e)?"),
    (40, "bsd", "bsd licen", r"bsd licen[cs]e[ds]?"),
    (40, "bsd", "license bsd", r"license bsd"),
    # ISC, zlib, Boost, public domain
    (95, "isc", "for any purpose with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    (68, "isc", "identifier isc", r"spdx license identifier isc"),
    (44, "isc", "isc licen", r"(?:the )?isc licen[cs]e[ds]?"),
    (42, "isc", "license isc", r"license isc"),
    (95, "zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    (94, "zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    (68, "zlib", "identifier zlib", r"spdx license identifier zlib"),
    (44, "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    (44, "libpng", "libpng licen", r"libpng licen[cs]e"),
    (95, "bsl-1.0", "obtaining a copy of the software", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (68, "bsl-1.0", "identifier bsl", r"spdx license identifier bsl 1 0"),
    (46, "bsl-1.0", "boost software", r"boost software licen[cs]e(?: (?:version |v )?1 0)?"),
    (95, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (68, "unlicense", "identifier unlicense", r"spdx license identifier unlicense"),
    (46, "unlicense", "unlicense org", r"unlicense org"),
    (44, "unlicense", "the unlicense", r"(?:under )?the unlicense"),
    (85, "public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    (84, "public-domain", "public domain", r"(?:this (?:work|software|file|code|document) is )(?:in|hereby in) the public domain"),
    (80, "wtfpl", "want to public", r"do what the fuck you want to public license"),
    (46, "wtfpl", "wtfpl", r"wtfpl(?: (?:version |v )?2)?"),
    # Mozilla, Eclipse, CDDL, EUPL and others with file-level copyleft
    (95, "mpl-2.0", "mozilla public license v", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (94, "mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    (70, "mpl-2.0", "mpl 2 0", r"spdx license identifier mpl 2 0"),
    (66, "mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"),
    (66, "mpl-2.0", "mozilla org", r"mozilla org en us mpl 2 0"),
    (54, "mpl-2.0", "mozilla public", r"mozilla public licen[cs]e (?:version |ver |v ?)?2(?: 0)?"),
    (54, "mpl-1.1", "mozilla public", r"mozilla public licen[cs]e (?:version |ver |v ?)?1 1"),
    (54, "mpl-1.0", "mozilla public", r"mozilla public licen[cs]e (?:version |ver |v ?)?1 0"),
    (52, "mpl-2.0", "mpl", r"mpl(?: version| v)? 2(?: 0)?"),
    (52, "mpl-2.0", "mpl v2", r"mpl v2(?: 0)?"),
    (52, "mpl-1.1", "mpl 1 1", r"mpl 1 1"),
    (42, "mpl", "mozilla public", r"mozilla public licen[cs]e"),
    (94, "epl-1.0", "eclipse public license v", r"made available under the terms of the eclipse public license v1 0"),
    (94, "epl-2.0", "eclipse public license", r"made available under the terms of the eclipse public license (?:v )?2 0"),
    (70, "epl-1.0", "epl 1 0", r"spdx license identifier epl 1 0"),
    (70, "epl-2.0", "epl 2 0", r"spdx license identifier epl 2 0"),
    (54, "epl-1.0", "eclipse public", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    (54, "epl-2.0", "eclipse public", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    (50, "epl-1.0", "epl v1", r"epl v1(?: 0)?"),
    (50, "epl-2.0", "epl v2", r"epl v2(?: 0)?"),
    (42, "epl", "eclipse public", r"eclipse public licen[cs]e"),
    (56, "cddl-1.0", "development and distribution", r"common development and distribution licen[cs]e (?:cddl )?(?:version |v )?1 0"),
    (56, "cddl-1.1", "development and distribution", r"common development and distribution licen[cs]e (?:cddl )?(?:version |v )?1 1"),
    (46, "cddl", "development and distribution", r"common development and distribution licen[cs]e"),
    (45, "cddl", "cddl", r"cddl(?: (?:version |v )?1 [01])?"),
    (54, "cpl-1.0", "common public licen", r"common public licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    (54, "ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    (56, "eupl-1.1", "european union public", r"european union public licen[cs]e (?:version |v )?1 1"),
    (56, "eupl-1.2", "european union public", r"european union public licen[cs]e (?:version |v )?1 2"),
    (46, "eupl", "european union public", r"european union public licen[cs]e"),
    (45, "eupl", "eupl", r"eupl(?: (?:version |v )?1 [012])?"),
    (46, "cecill", "cecill", r"cecill(?: (?:a|b|c|2 1|free software licen[cs]e))?"),
    (46, "osl-3.0", "open software", r"open software licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    (46, "afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    (54, "artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    (54, "artistic-1.0", "artistic", r"(?:the )?artistic licen[cs]e (?:version |v )?1(?: 0)?"),
    (42, "artistic", "artistic licen", r"(?:the )?artistic licen[cs]e"),
    (80, "perl", "terms as perl", r"under the same terms as perl(?: 5)? itself"),
    (46, "ms-pl", "microsoft public", r"microsoft public licen[cs]e(?: ms pl)?"),
    (46, "ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    (46, "apsl-2.0", "apple public source", r"apple public source licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    (46, "python-2.0", "python software foundation", r"python software foundation licen[cs]e(?: (?:version |v )?2)?"),
    (45, "python-2.0", "psf", r"psf licen[cs]e(?: (?:version |v )?2)?"),
    (46, "php-3.01", "php licen", r"php licen[cs]e(?: (?:version |v )?3(?: 01)?)?"),
    (46, "ruby", "ruby", r"(?:the )?ruby licen[cs]e"),
    (46, "postgresql", "postgresql", r"postgresql licen[cs]e"),
    (46, "openssl", "openssl", r"openssl licen[cs]e"),
    (46, "vim", "vim licen", r"vim licen[cs]e"),
    (46, "w3c", "w3c software", r"w3c software (?:notice and )?licen[cs]e"),
    (46, "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    (46, "upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version |v )?1 0)?"),
    (46, "ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?"),
    (46, "json", "good not evil", r"shall be used for good not evil"),
    (46, "beerware", "beer ware", r"beer ware licen[cs]e"),
    (46, "ecl-2.0", "educational community", r"educational community licen[cs]e(?: (?:version |v )?2 0)?"),
    (46, "mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v )?2)?"),
    (46, "odbl-1.0", "open database", r"open database licen[cs]e(?: odbl)?(?: (?:version |v )?1 0)?"),
    (46, "odbl-1.0", "odbl", r"odbl(?: 1 0)?"),
    (46, "pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    (46, "bigscience-openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m| s)?(?: licen[cs]e)?"),
    (46, "llama-community", "llama", r"llama(?: [234])? community licen[cs]e(?: agreement)?"),
    # Licenses that are not open source
    (70, "busl-1.1", "business source", r"business source licen[cs]e(?: (?:version |v )?1 1)?"),
    (60, "sspl-1.0", "server side public", r"server side public licen[cs]e(?: (?:version |v )?1)?"),
    (60, "elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    (58, "commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?"),
    (58, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[cs]e)?"),
    # Creative Commons
    (72, "cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    (72, "cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"),
    (72, "cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"),
    (71, "cc-by", "creativecommons org", r"creativecommons org licenses by"),
    (73, "cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa(?: [1234] [05])?"),
    (73, "cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: [1234] [05])?"),
    (73, "cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd(?: [1234] [05])?"),
    (74, "cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa(?: [1234] [05])?"),
    (74, "cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd(?: [1234] [05])?"),
    (60, "cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    (60, "cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?"),
    (58, "cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: use)?(?: [1234] [05])?"),
    (58, "cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?"),
    (58, "cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?"),
    (56, "cc-by-4.0", "creative commons", r"creative commons attribution 4 0"),
    (56, "cc-by-3.0", "creative commons", r"creative commons attribution 3 0"),
    (54, "cc-by", "creative commons", r"creative commons attribution"),
    (57, "cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1234] [05])?"),
    (57, "cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1234] [05])?"),
    (55, "cc-by-nc", "cc by nc", r"cc by nc(?: [1234] [05])?"),
    (55, "cc-by-sa", "cc by sa", r"cc by sa(?: [1234] [05])?"),
    (55, "cc-by-nd", "cc by nd", r"cc by nd(?: [1234] [05])?"),
    (53, "cc-by-4.0", "cc by", r"cc by 4 0"),
    (53, "cc-by-3.0", "cc by", r"cc by 3 0"),
    (51, "cc-by", "cc by", r"cc by licen[cs]e"),
    (56, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    (50, "creative-commons", "creative commons", r"creative commons licen[cs]e"),
    # Rights that are kept
    (35, "proprietary", "proprietary and confidential", r"proprietary and confidential"),
    (34, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)"),
    (33, "proprietary", "may not be reproduced", r"may not be reproduced(?: or (?:distributed|transmitted))? (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission"),
    (30, "proprietary", "all rights reserved", r"all rights reserved"),
)


def rules() -> list[tuple[int, int, str, bytes, re.Pattern[bytes]]]:
    """(priority, order, label, keyword, pattern), compiled to match whole words."""
    return [(p, i, label, k.encode(), re.compile(b" (?:" + t.encode() + b")(?= )")) for i, (p, label, k, t) in enumerate(RULES)]


#: No pattern matches as many words as this.
LONGEST = 64
#: ASCII only: capitals become small, letters, digits and bytes of other characters stay, the rest is space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan(text: bytes, keywords: dict[bytes, list]) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, detections) of one text."""
    words = text.translate(_TABLE).split()
    n = len(words)
    norm = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in BASE_PHRASES:
        needle = b" " + phrase.encode() + b" "
        at, word, counted = norm.find(needle), 0, 0
        while at >= 0:
            word += norm.count(b" ", counted, at)
            starts.append(word)
            base.add(label)
            counted, at = at, norm.find(needle, at + 1)
    found = []
    for keyword, gated in keywords.items():
        if keyword in norm:
            for priority, order, label, _, pattern in gated:
                word, counted = 0, 0
                for m in pattern.finditer(norm):
                    word += norm.count(b" ", counted, m.start())
                    counted = m.start()
                    found.append((-priority, -(m.end() - m.start()), order, word, word + m.group().count(b" "), label))
    found.sort()
    taken: list[tuple[int, int, str, int]] = []
    ends: dict[int, int] = {}  # the furthest end of what is taken, by first word
    for priority, _, _, first, end, label in found:
        if not any(ends.get(a, 0) >= end for a in range(first - LONGEST + 1, first + 1)):
            taken.append((first, end, label, -priority))
            ends[first] = max(ends.get(first, 0), end)
    labels = base | {t[2] for t in taken}
    score = max([t[3] / 100 for t in taken] + [0.4 if base else 0.0])
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, taken


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = worker_cache()
    if "license_rules" not in cache:
        gated: dict[bytes, list] = {}
        for rule in rules():
            gated.setdefault(rule[3], []).append(rule)
        cache["license_rules"] = gated
    keywords = cache["license_rules"]
    for batch in batches:
        rows = [scan(t or b"", keywords) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        spans = [[{"first": a, "end": b, "label": c, "priority": p} for a, b, c, p in t] for t in columns[7]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)], pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())])))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels, score and the detections that were not suppressed.

    A null or blank text has no words, no places (null first and last) and score
    0. Repeated rows give repeated results; ties between rules are settled by
    their order; a null id is kept. Very long texts are scanned whole. Extra columns
    are ignored, whatever their names; an empty table gives an empty result. Each
    text is judged alone, so there is no shuffle.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,end:long,label:string,priority:long>>"
    return slim.mapInArrow(_scan_batches, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


ship_by_value(__name__)
