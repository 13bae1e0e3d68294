"""Licence scans by ordered signature rules, in DataFrame functions only.

A text is lowered and reduced to words with single spaces. Each licence has a hand-written pattern of its name
and of its identifier; three signature forms make rules of them (identifier tag, grant or notice, bare name).
A rule is tried only where its keyword occurs. All its matches become intervals; an interval inside another is
suppressed, of equal ones the rule of higher priority stays, and of two that overlap in part the one of lower
priority goes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that are always reported.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, keyword, name pattern, identifier pattern or none) over lowered words with single spaces. The keyword is
#: in all that the name pattern matches.
LICENSES = (
    ("MIT", "mit", "mit licen[cs]e", "mit"),
    ("MIT", "expat", "expat licen[cs]e", None),
    ("MIT-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("X11", "x11", "x11 licen[cs]e", "x11"),
    ("ISC", "isc", "isc licen[cs]e", "isc"),
    ("0BSD", "zero clause", "(?:bsd )?zero clause(?: bsd)? licen[cs]e", "0bsd"),
    ("BSD-2-Clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("BSD-3-Clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd|revised bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("BSD-4-Clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("BSD", "bsd", "bsd (?:style )?licen[cs]e", "bsd"),
    ("Apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache 1 1"),
    ("Apache-2.0", "apache", "apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?", "apache 2 0"),
    ("Apache", "apache", "apache (?:software )?licen[cs]e", "apache"),
    ("GPL-1.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v)1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("GPL-2.0", "general public", "(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("GPL-3.0", "general public", "(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("GPL", "general public", "(?:gnu )?general public licen[cs]e", "gpl"),
    ("LGPL-2.0", "library general", "(?:gnu )?library general public licen[cs]e(?: (?:version |v)2(?: 0)?)?", "lgpl 2 0(?: only| or later)?"),
    ("LGPL-2.1", "lesser general", "(?:gnu )?lesser general public licen[cs]e (?:version |v)2 1", "lgpl 2 1(?: only| or later)?"),
    ("LGPL-3.0", "lesser general", "(?:gnu )?lesser general public licen[cs]e (?:version |v)3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("LGPL", "lesser general", "(?:gnu )?lesser general public licen[cs]e", "lgpl"),
    ("AGPL-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: (?:version |v)3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("AGPL-1.0", "affero", "affero general public licen[cs]e (?:version |v)1(?: 0)?", "agpl 1 0"),
    ("GFDL-1.1", "documentation", "gnu free documentation licen[cs]e (?:version |v)1 1", "gfdl 1 1(?: only| or later)?"),
    ("GFDL-1.2", "documentation", "gnu free documentation licen[cs]e (?:version |v)1 2", "gfdl 1 2(?: only| or later)?"),
    ("GFDL-1.3", "documentation", "gnu free documentation licen[cs]e (?:version |v)1 3", "gfdl 1 3(?: only| or later)?"),
    ("GFDL", "documentation", "gnu free documentation licen[cs]e", "gfdl"),
    ("MPL-1.0", "mozilla", "mozilla public licen[cs]e (?:version |v)?1 0", "mpl 1 0"),
    ("MPL-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    ("MPL-2.0", "mozilla", "mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("MPL", "mozilla", "mozilla public licen[cs]e", "mpl"),
    ("EPL-1.0", "eclipse", "eclipse public licen[cs]e (?:version |v)?1 0", "epl 1 0"),
    ("EPL-2.0", "eclipse", "eclipse public licen[cs]e (?:version |v)?2 0", "epl 2 0"),
    ("EPL", "eclipse", "eclipse public licen[cs]e", "epl"),
    ("EDL-1.0", "eclipse", "eclipse distribution licen[cs]e(?: (?:version |v)?1 0)?", "edl 1 0"),
    ("CPL-1.0", "common public", "common public licen[cs]e(?: (?:version |v)?1 0)?", "cpl 1 0"),
    ("CDDL-1.0", "common development", "common development and distribution licen[cs]e (?:version |v)?1 0", "cddl 1 0"),
    ("CDDL-1.1", "common development", "common development and distribution licen[cs]e (?:version |v)?1 1", "cddl 1 1"),
    ("CDDL", "common development", "common development and distribution licen[cs]e", "cddl"),
    ("EUPL-1.1", "european union", "european union public licen[cs]e (?:version |v)?1 1", "eupl 1 1"),
    ("EUPL-1.2", "european union", "european union public licen[cs]e (?:version |v)?1 2", "eupl 1 2"),
    ("EUPL", "european union", "european union public licen[cs]e", "eupl"),
    ("CECILL-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)? (?:version |v)?2 1", "cecill 2 1"),
    ("CECILL-B", "cecill", "cecill b(?: licen[cs]e)?", "cecill b"),
    ("CECILL-C", "cecill", "cecill c(?: licen[cs]e)?", "cecill c"),
    ("Artistic-1.0", "artistic", "artistic licen[cs]e (?:version |v)?1 0", "artistic 1 0"),
    ("Artistic-2.0", "artistic", "artistic licen[cs]e (?:version |v)?2 0", "artistic 2 0"),
    ("Artistic", "artistic", "artistic licen[cs]e", "artistic"),
    ("Zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("Libpng", "libpng", "libpng licen[cs]e(?: (?:version |v)?2)?", "libpng(?: 2 0)?"),
    ("BSL-1.0", "boost", "boost software licen[cs]e(?: (?:version |v)?1 0)?", "bsl 1 0"),
    ("BUSL-1.1", "business source", "business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1"),
    ("SSPL-1.0", "server side", "server side public licen[cs]e(?: (?:version |v)?1)?", "sspl 1 0"),
    ("Elastic-2.0", "elastic", "elastic licen[cs]e(?: (?:version |v)?2 0)?", "elastic 2 0"),
    ("Unlicense", "unlicense", "(?:the )?unlicense(?: org)?", "unlicense"),
    ("WTFPL", "do what the", "do what the fuck you want to public licen[cs]e", "wtfpl"),
    ("Beerware", "beer", "(?:the )?beer ?ware licen[cs]e", "beerware"),
    ("PostgreSQL", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("Python-2.0", "python", "python (?:software foundation )?licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "(?:python|psf) 2 0"),
    ("PHP-3.01", "php", "php licen[cs]e(?: (?:version |v)?3 0?1)?", "php 3 01"),
    ("Ruby", "ruby", "ruby(?: s)? licen[cs]e", "ruby"),
    ("Vim", "vim", "vim licen[cs]e", "vim"),
    ("OpenSSL", "openssl", "openssl(?: and ssleay)? licen[cs]e", "openssl"),
    ("curl", "curl", "curl licen[cs]e", "curl"),
    ("NCSA", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("AFL-3.0", "academic free", "academic free licen[cs]e(?: (?:version |v)?3 0)?", "afl 3 0"),
    ("OSL-3.0", "open software", "open software licen[cs]e(?: (?:version |v)?3 0)?", "osl 3 0"),
    ("ECL-2.0", "educational community", "educational community licen[cs]e(?: (?:version |v)?2 0)?", "ecl 2 0"),
    ("MS-PL", "microsoft public", "microsoft public licen[cs]e", "ms pl"),
    ("MS-RL", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("LPPL-1.3c", "latex project", "latex project public licen[cs]e(?: (?:version |v)?1 3c?)?", "lppl 1 3c?"),
    ("OFL-1.1", "open font", "(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "ofl 1 1"),
    ("Ubuntu-font-1.0", "ubuntu font", "ubuntu font licen[cs]e(?: (?:version |v)?1 0)?", "ubuntu font 1 0"),
    ("ODbL-1.0", "database", "open (?:data commons )?(?:open )?database licen[cs]e(?: (?:version |v)?1 0)?", "odbl 1 0"),
    ("ODC-By-1.0", "open data commons", "open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?", "odc by 1 0"),
    ("PDDL-1.0", "public domain dedication", "(?:open data commons )?public domain dedication (?:and )?licen[cs]e", "pddl 1 0"),
    ("CC0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("CC-BY-4.0", "cc by", "cc by 4 0", "cc by 4 0"),
    ("CC-BY-3.0", "cc by", "cc by 3 0", "cc by 3 0"),
    ("CC-BY-2.0", "cc by", "cc by 2 0", "cc by 2 0"),
    ("CC-BY-SA-4.0", "cc by", "cc by sa 4 0", "cc by sa 4 0"),
    ("CC-BY-SA-3.0", "cc by", "cc by sa 3 0", "cc by sa 3 0"),
    ("CC-BY-NC-4.0", "cc by", "cc by nc 4 0", "cc by nc 4 0"),
    ("CC-BY-NC-3.0", "cc by", "cc by nc 3 0", "cc by nc 3 0"),
    ("CC-BY-ND-4.0", "cc by", "cc by nd 4 0", "cc by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "cc by", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("CC-BY-NC-SA-3.0", "cc by", "cc by nc sa 3 0", "cc by nc sa 3 0"),
    ("CC-BY-NC-ND-4.0", "cc by", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("CC-BY-NC-ND-3.0", "cc by", "cc by nc nd 3 0", "cc by nc nd 3 0"),
    ("CC-BY", "creative commons", "creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?", "cc by"),
    ("CC-BY-SA", "creative commons", "creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)?", "cc by sa"),
    ("CC-BY-NC", "creative commons", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported| generic)?", "cc by nc"),
    ("CC-BY-ND", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported| generic)?", "cc by nd"),
    ("CC-BY-NC-SA", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported| generic)?", "cc by nc sa"),
    ("CC-BY-NC-ND", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported| generic)?", "cc by nc nd"),
    ("UPL-1.0", "universal permissive", "universal permissive licen[cs]e(?: (?:version |v)?1 0)?", "upl 1 0"),
    ("MulanPSL-2.0", "mulan", "mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v)?2)?", "mulanpsl 2 0"),
    ("BlueOak-1.0.0", "blue oak", "blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("Hippocratic-2.1", "hippocratic", "hippocratic licen[cs]e(?: (?:version |v)?2 1)?", "hippocratic 2 1"),
    ("OpenRAIL", "rail", "(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", "openrail"),
    ("Llama", "llama", "llama [2-4](?: [0-9])? community licen[cs]e", "llama [2-4]"),
    ("Intel-ACPI", "intel", "intel acpi(?: software)? licen[cs]e", "intel acpi"),
    ("IPL-1.0", "ibm public", "ibm public licen[cs]e(?: (?:version |v)?1 0)?", "ipl 1 0"),
    ("QPL-1.0", "q public", "q public licen[cs]e(?: (?:version |v)?1 0)?", "qpl 1 0"),
    ("Sleepycat", "sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    ("W3C", "w3c", "w3c (?:software )?(?:notice and )?licen[cs]e", "w3c"),
    ("ZPL-2.1", "zope", "zope public licen[cs]e(?: (?:version |v)?2 1)?", "zpl 2 1"),
    ("Unicode-3.0", "unicode", "unicode licen[cs]e(?: (?:v|version )?3)?", "unicode 3 0"),
    ("ICU", "icu", "icu licen[cs]e", "icu"),
    ("FTL", "freetype", "freetype (?:project )?licen[cs]e", "ftl"),
    ("IJG", "jpeg group", "independent jpeg group(?: licen[cs]e)?", "ijg"),
    ("APSL-2.0", "apple public", "apple public source licen[cs]e(?: (?:version |v)?2 0)?", "apsl 2 0"),
    ("AAL", "attribution assurance", "attribution assurance licen[cs]e", "aal"),
    ("APL-1.0", "adaptive public", "adaptive public licen[cs]e(?: (?:version |v)?1 0)?", "apl 1 0"),
    ("BitTorrent-1.1", "bittorrent", "bittorrent open source licen[cs]e(?: (?:version |v)?1 1)?", "bittorrent 1 1"),
    ("CAL-1.0", "cryptographic autonomy", "cryptographic autonomy licen[cs]e(?: (?:version |v)?1 0)?", "cal 1 0"),
    ("CATOSL-1.1", "computer associates", "computer associates trusted open source licen[cs]e(?: (?:version |v)?1 1)?", "catosl 1 1"),
    ("CPAL-1.0", "common public attribution", "common public attribution licen[cs]e(?: (?:version |v)?1 0)?", "cpal 1 0"),
    ("CUA-OPL-1.0", "cua office", "cua office public licen[cs]e(?: (?:version |v)?1 0)?", "cua opl 1 0"),
    ("EFL-2.0", "eiffel forum", "eiffel forum licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "efl 2 0"),
    ("Entessa", "entessa", "entessa public licen[cs]e(?: (?:version |v)?1 0)?", "entessa"),
    ("EUDatagrid", "eu datagrid", "eu datagrid software licen[cs]e", "eudatagrid"),
    ("Fair", "fair licen", "fair licen[cs]e", "fair"),
    ("Frameworx-1.0", "frameworx", "frameworx open licen[cs]e(?: (?:version |v)?1 0)?", "frameworx 1 0"),
    ("HPND", "historical permission", "historical permission notice and disclaimer(?: licen[cs]e)?", "hpnd"),
    ("IPA", "ipa font", "ipa font licen[cs]e", "ipa"),
    ("LPL-1.02", "lucent public", "lucent public licen[cs]e(?: (?:version |v)?1 0 ?2)?", "lpl 1 02"),
    ("MirOS", "miros", "miros licen[cs]e", "miros"),
    ("Motosoto", "motosoto", "motosoto open source licen[cs]e", "motosoto"),
    ("Multics", "multics", "multics licen[cs]e", "multics"),
    ("NASA-1.3", "nasa open", "nasa open source agreement(?: (?:version |v)?1 3)?", "nasa 1 3"),
    ("Naumen", "naumen", "naumen public licen[cs]e", "naumen"),
    ("NGPL", "nethack", "nethack general public licen[cs]e", "ngpl"),
    ("Nokia", "nokia", "nokia open source licen[cs]e", "nokia"),
    ("NPOSL-3.0", "non profit open", "non profit open software licen[cs]e(?: (?:version |v)?3 0)?", "nposl 3 0"),
    ("NTP", "ntp licen", "ntp licen[cs]e", "ntp"),
    ("OCLC-2.0", "oclc", "oclc research public licen[cs]e(?: (?:version |v)?2 0)?", "oclc 2 0"),
    ("OGL-UK", "open government", "open government licen[cs]e(?: (?:version |v)?[1-3] 0)?", "ogl uk [1-3] 0"),
    ("OLDAP-2.8", "openldap", "openldap public licen[cs]e(?: (?:version |v)?2 8)?", "oldap 2 8"),
    ("OSET-PL-2.1", "oset", "oset (?:foundation )?public licen[cs]e(?: (?:version |v)?2 1)?", "oset pl 2 1"),
    ("RPL-1.5", "reciprocal public", "reciprocal public licen[cs]e(?: (?:version |v)?1 [15])?", "rpl 1 [15]"),
    ("RPSL-1.0", "realnetworks", "realnetworks public source licen[cs]e(?: (?:version |v)?1 0)?", "rpsl 1 0"),
    ("RSCPL", "ricoh", "ricoh source code public licen[cs]e", "rscpl"),
    ("SimPL-2.0", "simple public", "simple public licen[cs]e(?: (?:version |v)?2 0)?", "simpl 2 0"),
    ("SISSL", "sun industry", "sun industry standards source licen[cs]e", "sissl"),
    ("SPL-1.0", "sun public", "sun public licen[cs]e(?: (?:version |v)?1 0)?", "spl 1 0"),
    ("TCL", "tcl tk", "tcl tk licen[cs]e", "tcl"),
    ("UCL-1.0", "upstream compatibility", "upstream compatibility licen[cs]e(?: (?:version |v)?1 0)?", "ucl 1 0"),
    ("VSL-1.0", "vovida", "vovida software licen[cs]e(?: (?:version |v)?1 0)?", "vsl 1 0"),
    ("Watcom-1.0", "watcom", "sybase open watcom public licen[cs]e(?: (?:version |v)?1 0)?", "watcom 1 0"),
    ("Xnet", "x net licen", "x net licen[cs]e", "xnet"),
    ("YPL-1.1", "yahoo public", "yahoo public licen[cs]e(?: (?:version |v)?1 [01])?", "ypl 1 [01]"),
    ("Info-ZIP", "info zip", "info zip licen[cs]e", "info zip"),
    ("JSON", "json licen", "json licen[cs]e", "json"),
    ("SGI-B-2.0", "sgi free", "sgi free software licen[cs]e b(?: (?:version |v)?2 0)?", "sgi b 2 0"),
    ("TOSL", "trusster", "trusster open source licen[cs]e", "tosl"),
    ("CERN-OHL-P-2.0", "cern open", "cern open hardware licen[cs]e (?:version |v)?2 permissive", "cern ohl p 2 0"),
    ("CERN-OHL-W-2.0", "cern open", "cern open hardware licen[cs]e (?:version |v)?2 weakly reciprocal", "cern ohl w 2 0"),
    ("CERN-OHL-S-2.0", "cern open", "cern open hardware licen[cs]e (?:version |v)?2 strongly reciprocal", "cern ohl s 2 0"),
    ("CERN-OHL", "cern open", "cern open hardware licen[cs]e(?: (?:version |v)?1 [12])?", "cern ohl 1 [12]"),
    ("TAPR-OHL-1.0", "tapr", "tapr open hardware licen[cs]e(?: (?:version |v)?1 0)?", "tapr ohl 1 0"),
    ("SHL-0.51", "solderpad", "solderpad hardware licen[cs]e(?: (?:version |v)?0 51)?", "shl 0 51"),
    ("PolyForm-Noncommercial", "polyform noncommercial", "polyform noncommercial licen[cs]e(?: (?:version |v)?1 0 0)?", "polyform noncommercial 1 0 0"),
    ("PolyForm-Small-Business", "polyform small", "polyform small business licen[cs]e(?: (?:version |v)?1 0 0)?", "polyform small business 1 0 0"),
    ("Parity-7.0.0", "parity public", "parity public licen[cs]e(?: (?:version |v)?7 0 0)?", "parity 7 0 0"),
    ("Commons-Clause", "commons clause", "commons clause(?: licen[cs]e)?(?: condition)?", None),
    ("Gemma", "gemma", "gemma (?:terms of use|licen[cs]e)", None),
    ("DL-DE", "germany", "data licen[cs]e germany (?:attribution|zero)(?: (?:version |v)?2 0)?", "dl de (?:by|zero) 2 0"),
    ("etalab-2.0", "licence ouverte", "(?:etalab )?licence ouverte(?: open licen[cs]e)?(?: (?:version |v)?2 0)?", "etalab 2 0"),
    ("CDLA-Permissive", "community data", "community data licen[cs]e agreement permissive(?: (?:version |v)?[12] 0)?", "cdla permissive [12] 0"),
    ("CDLA-Sharing-1.0", "community data", "community data licen[cs]e agreement sharing(?: (?:version |v)?1 0)?", "cdla sharing 1 0"),
    ("ASWF-Digital-Assets", "aswf", "aswf digital assets licen[cs]e(?: (?:version |v)?1 [01])?", "aswf digital assets 1 [01]"),
    ("Arphic-1999", "arphic", "arphic public licen[cs]e", "arphic 1999"),
    ("Bitstream-Vera", "bitstream vera", "bitstream vera (?:fonts )?(?:copyright|licen[cs]e)", "bitstream vera"),
    ("Baekmuk", "baekmuk", "baekmuk (?:fonts )?licen[cs]e", "baekmuk"),
    ("Condor-1.1", "condor", "condor public licen[cs]e(?: (?:version |v)?1 1)?", "condor 1 1"),
    ("Knuth-CTAN", "knuth", "knuth (?:ctan )?licen[cs]e", "knuth ctan"),
    ("Net-SNMP", "net snmp", "net snmp licen[cs]e", "net snmp"),
    ("Zend-2.0", "zend", "zend (?:engine )?licen[cs]e(?: (?:version |v)?2 0)?", "zend 2 0"),
    ("Xiph", "xiph", "xiph (?:org )?(?:bsd )?licen[cs]e", None),
    ("AFPL", "aladdin", "aladdin free public licen[cs]e", "aladdin"),
)
#: Whole sentences: (label, keyword, pattern).
SENTENCES = (
    ("MIT", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("ISC", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("GPL", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("LGPL", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("Zlib", "as is without", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("Unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("Public-Domain", "public domain", "(?:released|placed|dedicated|donated) (?:in|in ?to|to) the public domain"),
    ("Proprietary", "all rights reserved", "copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved"),
    ("Proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("Apache", "unless required by", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("Apache", "you may not use this file", "you may not use this file except in compliance with the licen[cs]e"),
    ("MIT", "this permission notice", "(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT", "the software is provided", "the software is provided as is without warranty of any kind express or implied"),
    ("BSD", "neither the name", "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("BSD", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("BSD", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("GPL", "without any warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("LGPL", "without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("GPL", "you should have received", "you should have received a copy of the gnu general public licen[cs]e"),
    ("LGPL", "you should have received", "you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("AGPL", "you should have received", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("MPL", "source code form is subject", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("EPL", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) licen[cs]e"),
    ("CDDL", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("OFL-1.1", "this font software", "this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("CC", "this work is", "this work is licen[cs]ed under (?:a|the) creative commons"),
    ("CC0-1.0", "waived all copyright", "has waived all copyright and related or neighbou?ring rights"),
    ("Python-2.0", "hereby grants", "psf hereby grants licen[cs]ee a nonexclusive royalty free world ?wide licen[cs]e"),
    ("Artistic", "package", "you may distribute this package under the terms of the artistic licen[cs]e"),
    ("Proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("Proprietary", "no part of this", "no part of this (?:document|publication|book|work) may be (?:reproduced|copied|distributed)"),
    ("Proprietary", "internal use only", "for internal use only"),
    ("Proprietary", "do not distribute", "confidential do not distribute"),
    ("Proprietary", "trade secret", "(?:contains|constitutes) (?:proprietary |confidential |valuable )?trade secrets?"),
    ("Non-Commercial", "non commercial use", "for (?:personal|academic|research|educational)(?: and)? non commercial use only"),
    ("Non-Commercial", "non commercial purposes", "for non commercial purposes only"),
    ("Evaluation", "evaluation purposes", "for evaluation purposes only"),
    ("Patent", "patent licen", "patent licen[cs]e (?:is )?(?:hereby )?granted"),
    ("EULA", "end user", "end user licen[cs]e agreement"),
    ("Public-Domain", "public domain", "(?:is|are) (?:hereby )?in the public domain"),
    ("Copyleft", "copyleft", "copyleft (?:all wrongs reserved|licen[cs]e)"),
    ("Dual", "dual licen", "dual licen[cs]ed under"),
    ("GPL", "gplv", "(?:gnu )?gplv[23]"),
    ("GPL", "gnu gpl", "gnu gpl(?: (?:version |v)?[23](?: 0)?)?"),
    ("LGPL", "lgplv", "(?:gnu )?lgplv[23](?: 1)?"),
    ("LGPL", "gnu lgpl", "gnu lgpl(?: (?:version |v)?[23](?: [01])?)?"),
    ("AGPL", "agplv", "(?:gnu )?agplv3"),
    ("MIT", "mit x11", "mit x11(?: style)?(?: licen[cs]e)?"),
    ("Attribution", "attribution required", "attribution required"),
)
GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed|redistribute it)(?: to you)? (?:under|with|by)(?: the)?(?: terms of)?(?: the)? "
#: Priority and confidence of the forms.
TAG, NOTICE, SENTENCE, NAME = (4, 0.99), (3, 0.95), (2, 0.9), (1, 0.7)
#: Words that every rule's match holds, tested once before any rule.
ROOTS = ("licen", "spdx", "copyright", "public domain", "cc0", "cc by", "creative commons", "redistribution and use", "permission is hereby", "permission to use", "proprietary", "free software", "as is without", "unencumbered", "cecill", "bsd", "rail", "mulan", "jpeg group", "mit no attribution", "historical permission", "nasa open", "commons clause", "gemma", "neither the name", "without any warranty", "unauthorized copying", "no part of this", "internal use only", "do not distribute", "trade secret", "non commercial", "evaluation purposes", "copyleft", "gplv", "gnu gpl", "gnu lgpl", "mit x11", "attribution required")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence) in order.

    Patterns are for words with two spaces between them: each takes one on either side, so that neighbours share none.
    """
    out = []
    for label, key, name, identifier in LICENSES:
        if identifier:
            out.append((label, "spdx", f" spdx licen[cs]e identifier {identifier} ", *TAG))
        out.append((label, key, f" {GRANT}(?:{name}) ", *NOTICE))
        out.append((label, key, f" (?:{name}) ", *NAME))
    out += [(label, key, f" (?:{pattern}) ", *SENTENCE) for label, key, pattern in SENTENCES]
    twice = lambda x: "(?:  )?".join(y.replace(" ", "  ") for y in x.split(" ?"))
    return [(label, key, f" {twice(pattern[1:-1])} ", *rest) for label, key, pattern, *rest in out]


def normal(text: Column) -> Column:
    """Lowered words (A-Z only) with single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "))


#: Distances of the passes of :func:`_running`: no array is longer than the last.
STEPS = tuple(1 << k for k in range(31))


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of each value and all before it, by doubling: log2(n) passes over an array of n values, none of which
    appends to a growing one. ``both`` gets null where nothing is before."""
    steps = F.array(*(F.lit(s) for s in STEPS))
    return F.aggregate(steps, values, lambda a, s: F.when(s < F.size(a), F.transform(a, lambda x, i: both(x, F.get(a, i - s)))).otherwise(a))


def _spans(text: Column, rule: Column) -> Column:
    """All matches of ``rule`` in ``text`` as structs (start, end, priority, rule number, label, confidence).

    A match ends where the parts between matches and the matches up to it end: a running sum of their lengths.
    """
    cut = F.struct(F.split(text, rule["pattern"], -1).alias("p"), F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("m"))

    def of(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["p"], 1, F.size(x["m"])), x["m"], lambda p, m: F.length(p) + F.length(m))
        ends = _running(lengths, lambda a, b: a + F.coalesce(b, F.lit(0)))
        return F.zip_with(x["m"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), (-e).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["number"].alias("number"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    return F.flatten(F.transform(F.array(cut), of))  # both arrays are made once


def _places(parts: list[str], label: str) -> Column:
    """Where the words of one base phrase stand in _w."""
    same = lambda i: reduce(lambda a, b: a & b, (F.get("_w", i + j) == w for j, w in enumerate(parts)))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - len(parts), F.lit(0))), lambda i: F.coalesce(same(i), F.lit(False)))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))


def detected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with license_words, license_base (place and label of base phrases) and license_found.

    license_found has the surviving detections by start: start and end in the text of words with two spaces between
    them and one at either end, priority, label, confidence. Null and empty texts have no words and no detections.
    Of a very long text the words, the matches of all rules and their running ends are in memory at once; the work grows
    with n log n of its matches.
    Other columns pass through; those named like the three new ones are replaced.
    """
    kept_columns = [c for c in docs.columns if c not in ("license_words", "license_base", "license_found")]
    whole = F.struct(*(F.col(f"`{c}`") for c in kept_columns)).alias("_row")
    table = F.array(*(F.struct(F.lit(i).alias("number"), F.lit(a).alias("label"), F.lit(k).alias("key"), F.lit(p).alias("pattern"), F.lit(w).alias("priority"), F.lit(c).alias("confidence")) for i, (a, k, p, w, c) in enumerate(rules())))
    rows = docs.select(normal(F.col(text_col)).alias("_n"), whole)
    words = F.when(F.col("_n") == "", F.lit(0)).otherwise(F.length("_n") - F.length(F.translate("_n", " ", "")) + 1)
    rows = rows.withColumn("license_words", words.cast("long"))
    rows = rows.withColumn("_x", F.when(reduce(lambda a, b: a | b, (F.contains(F.col("_n"), F.lit(r)) for r in ROOTS)), F.concat(F.lit(" "), F.replace("_n", F.lit(" "), F.lit("  ")), F.lit(" "))))
    rows = rows.withColumn("_w", F.when(F.col("_x").isNotNull() & F.contains(F.col("_n"), F.lit("license")), F.split("_n", " ")))
    places = [_places(phrase.split(), label) for phrase, label in BASE]
    rows = rows.withColumn("license_base", F.coalesce(F.when(F.col("_w").isNotNull(), F.concat(*places)), F.array().cast("array<struct<place:bigint,label:string>>")))
    tried = F.filter(table, lambda r: F.contains(F.col("_n"), r["key"]))
    found = F.when(F.col("_x").isNotNull(), F.sort_array(F.flatten(F.transform(tried, lambda r: _spans(F.col("_x"), r)))))
    rows = rows.withColumn("_f", found)
    # By start, then longest, then priority: an interval inside an earlier one ends no later than all before it.
    # The running ends are bound as an array's element: as a column they would be inlined into the filter and made per match.
    reach = F.array(_running(F.transform("_f", lambda x: -x["minus_end"]), lambda a, b: F.greatest(a, b)))
    free = F.flatten(F.transform(reach, lambda r: F.filter("_f", lambda x, i: -x["minus_end"] > F.coalesce(F.get(r, i - 1), F.lit(0)))))
    rows = rows.withColumn("_g", free)
    beaten = lambda x, y: F.coalesce((x["start"] < -y["minus_end"] - 1) & (y["start"] < -x["minus_end"] - 1) & (y["minus_priority"] < x["minus_priority"]), F.lit(False))
    kept = F.filter("_g", lambda x, i: ~beaten(x, F.get("_g", i - 1)) & ~beaten(x, F.get("_g", i + 1)))
    final = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), (-x["minus_priority"]).alias("priority"), x["label"].alias("label"), x["confidence"].alias("confidence")))
    rows = rows.withColumn("license_found", F.coalesce(final, F.array().cast("array<struct<start:int,end:int,priority:int,label:string,confidence:double>>")))
    return rows.select("_row.*", "license_words", "license_base", "license_found")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, base places and labels, all labels, and the highest confidence (0.6 for a base phrase alone).

    Null and empty texts have no words, null places, empty labels and score 0; repeated rows and null ids each give a row.
    """
    rows = detected(docs.select(id_col, text_col), text_col)
    place = F.transform("license_base", lambda x: x["place"])
    base = F.array_distinct(F.transform("license_base", lambda x: x["label"]))
    every = F.array_union(base, F.transform("license_found", lambda x: x["label"]))
    best = F.greatest(F.coalesce(F.array_max(F.transform("license_found", lambda x: x["confidence"])), F.lit(0.0)), F.when(F.size("license_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    return rows.select(
        id_col,
        F.col("license_words").alias("n_words"),
        F.size("license_base").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        best.alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL of :func:`digest` for documents with different ids."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {quote(a)}, {quote(k)}, {quote(p)}, {w}, {c})" for i, (a, k, p, w, c) in enumerate(rules()))
    roots = " OR ".join(f"contains(n, {quote(r)})" for r in ROOTS)
    places = ", ".join("list_transform(list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {j + 1}] = {quote(x)}" for j, x in enumerate(p.split())) + f"), lambda i: {{'place': i, 'label': {quote(b)}}})" for p, b in BASE)
    return rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}', ' ', 'g'), ' ') AS n FROM documents),
w AS (SELECT doc_id, n, CASE WHEN n = '' THEN [] ELSE string_split(n, ' ') END AS w FROM d),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, flatten([{places}]) AS b FROM w),
r(number, label, key, pattern, priority, confidence) AS (VALUES {table}),
x AS (SELECT doc_id, n, ' ' || replace(n, ' ', '  ') || ' ' AS x FROM d WHERE {roots}),
t AS (SELECT doc_id, number, label, priority, confidence, regexp_extract_all(x, pattern) AS m, string_split_regex(x, pattern) AS p FROM x JOIN r ON contains(x.n, r.key)),
s AS (SELECT doc_id, number, label, priority, confidence,
  list_sum(list_transform(p[1 : k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda y: length(y))), 0) AS a, length(m[k]) AS l
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM t WHERE len(m) > 0)),
e AS (SELECT *, a + l AS z, row_number() OVER o AS o, max(a + l) OVER (PARTITION BY doc_id ORDER BY a, -(a + l), -priority, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY a, -(a + l), -priority, number)),
g AS (SELECT * FROM e WHERE reach IS NULL OR z > reach),
h AS (SELECT *, lag(z) OVER o AS pz, lag(priority) OVER o AS pp, lead(a) OVER o AS na, lead(priority) OVER o AS np FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY o)),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(confidence) AS c FROM h
  WHERE NOT coalesce(a < pz - 1 AND pp > priority, false) AND NOT coalesce(na < z - 1 AND np > priority, false) GROUP BY 1)
SELECT doc_id, n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda y: y.place)) AS first_word, list_max(list_transform(b, lambda y: y.place)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda y: y.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(b, lambda y: y.label), coalesce(labels, [])))), ',') AS labels,
  greatest(coalesce(c, 0), CASE WHEN len(b) > 0 THEN 0.6 ELSE 0 END)::DOUBLE AS score
FROM b LEFT JOIN f USING (doc_id)"""
