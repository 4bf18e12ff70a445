"""Hand-written licence signatures: keyword | priority | licence | pattern, one to a line.

The keyword (lower case) names the rule's subject; what must occur before a pattern is tried is read
from the pattern itself.
Patterns ignore case; a blank in a pattern stands for any white space. Priority: 9 identifier
tags, 7 full names with version, 6 phrases typical of one licence's text, 5 addresses,
3 names without version, 1 hints that some licence is meant.
"""

TABLE = r"""
spdx-license-identifier|9|MIT|SPDX-License-Identifier: MIT\b(?!-)
spdx-license-identifier|9|MIT-0|SPDX-License-Identifier: MIT-0\b
spdx-license-identifier|9|Apache-2.0|SPDX-License-Identifier: Apache-2\.0\b
spdx-license-identifier|9|Apache-1.1|SPDX-License-Identifier: Apache-1\.1\b
spdx-license-identifier|9|GPL-2.0-only|SPDX-License-Identifier: GPL-2\.0(?:-only)?(?![-+\w])
spdx-license-identifier|9|GPL-2.0-or-later|SPDX-License-Identifier: GPL-2\.0(?:-or-later|\+)
spdx-license-identifier|9|GPL-3.0-only|SPDX-License-Identifier: GPL-3\.0(?:-only)?(?![-+\w])
spdx-license-identifier|9|GPL-3.0-or-later|SPDX-License-Identifier: GPL-3\.0(?:-or-later|\+)
spdx-license-identifier|9|LGPL-2.1-only|SPDX-License-Identifier: LGPL-2\.1(?:-only)?(?![-+\w])
spdx-license-identifier|9|LGPL-2.1-or-later|SPDX-License-Identifier: LGPL-2\.1(?:-or-later|\+)
spdx-license-identifier|9|LGPL-3.0-only|SPDX-License-Identifier: LGPL-3\.0(?:-only)?(?![-+\w])
spdx-license-identifier|9|LGPL-3.0-or-later|SPDX-License-Identifier: LGPL-3\.0(?:-or-later|\+)
spdx-license-identifier|9|AGPL-3.0-only|SPDX-License-Identifier: AGPL-3\.0(?:-only)?(?![-+\w])
spdx-license-identifier|9|AGPL-3.0-or-later|SPDX-License-Identifier: AGPL-3\.0(?:-or-later|\+)
spdx-license-identifier|9|BSD-2-Clause|SPDX-License-Identifier: BSD-2-Clause(?!-)
spdx-license-identifier|9|BSD-2-Clause-Patent|SPDX-License-Identifier: BSD-2-Clause-Patent\b
spdx-license-identifier|9|BSD-3-Clause|SPDX-License-Identifier: BSD-3-Clause(?!-)
spdx-license-identifier|9|BSD-3-Clause-Clear|SPDX-License-Identifier: BSD-3-Clause-Clear\b
spdx-license-identifier|9|BSD-4-Clause|SPDX-License-Identifier: BSD-4-Clause\b
spdx-license-identifier|9|0BSD|SPDX-License-Identifier: 0BSD\b
spdx-license-identifier|9|ISC|SPDX-License-Identifier: ISC\b
spdx-license-identifier|9|MPL-1.1|SPDX-License-Identifier: MPL-1\.1\b
spdx-license-identifier|9|MPL-2.0|SPDX-License-Identifier: MPL-2\.0\b
spdx-license-identifier|9|EPL-1.0|SPDX-License-Identifier: EPL-1\.0\b
spdx-license-identifier|9|EPL-2.0|SPDX-License-Identifier: EPL-2\.0\b
spdx-license-identifier|9|CDDL-1.0|SPDX-License-Identifier: CDDL-1\.0\b
spdx-license-identifier|9|CDDL-1.1|SPDX-License-Identifier: CDDL-1\.1\b
spdx-license-identifier|9|EUPL-1.2|SPDX-License-Identifier: EUPL-1\.2\b
spdx-license-identifier|9|EUPL-1.1|SPDX-License-Identifier: EUPL-1\.1\b
spdx-license-identifier|9|Unlicense|SPDX-License-Identifier: Unlicense\b
spdx-license-identifier|9|WTFPL|SPDX-License-Identifier: WTFPL\b
spdx-license-identifier|9|Zlib|SPDX-License-Identifier: Zlib\b
spdx-license-identifier|9|BSL-1.0|SPDX-License-Identifier: BSL-1\.0\b
spdx-license-identifier|9|BUSL-1.1|SPDX-License-Identifier: BUSL-1\.1\b
spdx-license-identifier|9|CC0-1.0|SPDX-License-Identifier: CC0-1\.0\b
spdx-license-identifier|9|CC-BY-4.0|SPDX-License-Identifier: CC-BY-4\.0\b
spdx-license-identifier|9|CC-BY-3.0|SPDX-License-Identifier: CC-BY-3\.0\b
spdx-license-identifier|9|CC-BY-SA-4.0|SPDX-License-Identifier: CC-BY-SA-4\.0\b
spdx-license-identifier|9|CC-BY-SA-3.0|SPDX-License-Identifier: CC-BY-SA-3\.0\b
spdx-license-identifier|9|CC-BY-NC-4.0|SPDX-License-Identifier: CC-BY-NC-4\.0\b
spdx-license-identifier|9|CC-BY-NC-SA-4.0|SPDX-License-Identifier: CC-BY-NC-SA-4\.0\b
spdx-license-identifier|9|CC-BY-NC-ND-4.0|SPDX-License-Identifier: CC-BY-NC-ND-4\.0\b
spdx-license-identifier|9|CC-BY-ND-4.0|SPDX-License-Identifier: CC-BY-ND-4\.0\b
spdx-license-identifier|9|Artistic-2.0|SPDX-License-Identifier: Artistic-2\.0\b
spdx-license-identifier|9|Artistic-1.0|SPDX-License-Identifier: Artistic-1\.0\b
spdx-license-identifier|9|Python-2.0|SPDX-License-Identifier: (?:Python-2\.0|PSF-2\.0)\b
spdx-license-identifier|9|PostgreSQL|SPDX-License-Identifier: PostgreSQL\b
spdx-license-identifier|9|OFL-1.1|SPDX-License-Identifier: OFL-1\.1\b
spdx-license-identifier|9|MS-PL|SPDX-License-Identifier: MS-PL\b
spdx-license-identifier|9|SSPL-1.0|SPDX-License-Identifier: SSPL-1\.0\b
spdx-license-identifier|9|Elastic-2.0|SPDX-License-Identifier: Elastic-2\.0\b
spdx-license-identifier|9|ODbL-1.0|SPDX-License-Identifier: ODbL-1\.0\b
spdx-license-identifier|9|NCSA|SPDX-License-Identifier: NCSA\b
spdx-license-identifier|9|Ruby|SPDX-License-Identifier: Ruby\b
spdx-license-identifier|9|Vim|SPDX-License-Identifier: Vim\b
spdx-license-identifier|9|X11|SPDX-License-Identifier: X11\b
spdx-license-identifier|9|AFL-3.0|SPDX-License-Identifier: AFL-3\.0\b
spdx-license-identifier|9|MulanPSL-2.0|SPDX-License-Identifier: MulanPSL-2\.0\b
spdx-license-identifier|2|other|SPDX-License-Identifier: [\w.+-]+(?: (?:AND|OR|WITH) [\w.+-]+)*
mit license|7|MIT|(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?MIT licen[cs]e
mit license|3|MIT|\bMIT licen[cs]e\b
mit licence|3|MIT|\bMIT licence\b
expat|3|MIT|\bexpat licen[cs]e\b
permission is hereby granted|6|MIT|permission is hereby granted, free of charge, to any person obtaining a copy of this software
the above copyright notice and this permission notice|6|MIT|the above copyright notice and this permission notice shall be included in all copies or substantial portions
opensource.org/licenses/mit|5|MIT|https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php)?
the software is provided|4|MIT|the software is provided .as is., without warranty of any kind, express or implied
x11 license|3|X11|\bX11 licen[cs]e\b
mit no attribution|7|MIT-0|\bMIT no attribution\b
apache license|7|Apache-2.0|licensed under (?:the )?(?:terms of the )?apache licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?
apache license|6|Apache-2.0|apache licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?
apache license|6|Apache-1.1|apache (?:software )?licen[cs]e,? (?:version|v\.?) ?1\.1
apache license|6|Apache-1.0|apache (?:software )?licen[cs]e,? (?:version|v\.?) ?1\.0
apache license|3|Apache|\bapache licen[cs]e\b
apache software license|3|Apache|\bapache software licen[cs]e\b
apache-2.0|6|Apache-2.0|\bapache-2\.0\b
apache 2|5|Apache-2.0|\bapache 2(?:\.0)? licen[cs]e\b
apache.org/licenses/license-2.0|5|Apache-2.0|https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache.org/licenses/license-1.1|5|Apache-1.1|https?://(?:www\.)?apache\.org/licenses/license-1\.1
you may not use this file except in compliance|6|Apache-2.0|you may not use this file except in compliance with the licen[cs]e
gnu general public license|7|GPL-3.0-or-later|gnu general public licen[cs]e,? (?:as published by the free software foundation[,;]? )?(?:either )?version 3(?:\.0)?(?: of the licen[cs]e)?,? or (?:\(at your option\) )?any later version
gnu general public license|7|GPL-2.0-or-later|gnu general public licen[cs]e,? (?:as published by the free software foundation[,;]? )?(?:either )?version 2(?:\.0)?(?: of the licen[cs]e)?,? or (?:\(at your option\) )?any later version
gnu general public license|7|GPL-3.0-only|(?:this work is )?licensed under the gnu general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?
gnu general public license|6|GPL-3.0-only|gnu general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?
gnu general public license|6|GPL-2.0-only|gnu general public licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?
gnu general public license|6|GPL-1.0-only|gnu general public licen[cs]e,? (?:version|v\.?) ?1(?:\.0)?\b
gnu general public license|3|GPL|\bgnu general public licen[cs]e\b
gplv3|5|GPL-3.0-only|\bGPL[- ]?v\.?3\b(?!\+)
gplv3+|5|GPL-3.0-or-later|\bGPL[- ]?v\.?3\+
gplv2|5|GPL-2.0-only|\bGPL[- ]?v\.?2\b(?!\+)
gplv2+|5|GPL-2.0-or-later|\bGPL[- ]?v\.?2\+
gpl-3.0|5|GPL-3.0-only|\b(?<![la])gpl-3\.0(?:-only)?\b(?!-or|\+)
gpl-2.0|5|GPL-2.0-only|\b(?<![la])gpl-2\.0(?:-only)?\b(?!-or|\+)
gnu gpl|3|GPL|\bgnu gpl\b
gnu.org/licenses/gpl-3|5|GPL-3.0-only|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.\w+)?
gnu.org/licenses/gpl-2|5|GPL-2.0-only|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.\w+)?
gnu.org/licenses|2|GPL|https?://(?:www\.)?gnu\.org/licenses/?
this program is free software|6|GPL|this program is free software[:;,] you can redistribute it and/or modify it under the terms of
this program is distributed in the hope|4|GPL|this program is distributed in the hope that it will be useful, but without any warranty
gnu lesser general public license|7|LGPL-3.0-only|gnu lesser general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?
gnu lesser general public license|7|LGPL-2.1-only|gnu lesser general public licen[cs]e,? (?:version|v\.?) ?2\.1
gnu lesser general public license|3|LGPL|\bgnu lesser general public licen[cs]e\b
gnu library general public license|7|LGPL-2.0-only|gnu library general public licen[cs]e(?:,? (?:version|v\.?) ?2(?:\.0)?)?
lgplv3|5|LGPL-3.0-only|\bLGPL[- ]?v\.?3\b
lgplv2.1|5|LGPL-2.1-only|\bLGPL[- ]?v\.?2\.1\b
gnu lgpl|3|LGPL|\bgnu lgpl\b
gnu.org/licenses/lgpl|5|LGPL|https?://(?:www\.)?gnu\.org/licenses/lgpl[-\w.]*
gnu affero general public license|7|AGPL-3.0-only|gnu affero general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?
gnu affero general public license|3|AGPL|\bgnu affero general public licen[cs]e\b
agplv3|5|AGPL-3.0-only|\bAGPL[- ]?v\.?3\b
agpl-3.0|5|AGPL-3.0-only|\bagpl-3\.0(?:-only)?\b
gnu.org/licenses/agpl|5|AGPL-3.0-only|https?://(?:www\.)?gnu\.org/licenses/agpl[-\w.]*
gnu free documentation license|7|GFDL-1.3|gnu free documentation licen[cs]e,? (?:version|v\.?) ?1\.3
gnu free documentation license|7|GFDL-1.2|gnu free documentation licen[cs]e,? (?:version|v\.?) ?1\.2
gnu free documentation license|3|GFDL|\bgnu free documentation licen[cs]e\b
gnu all-permissive|3|FSFAP|\bgnu all-permissive licen[cs]e\b
copying and distribution of this file|6|FSFAP|copying and distribution of this file, with or without modification, are permitted in any medium
2-clause bsd|6|BSD-2-Clause|\b2-clause bsd(?: licen[cs]e)?\b
bsd 2-clause|6|BSD-2-Clause|\bbsd 2-clause(?: licen[cs]e)?\b
simplified bsd|6|BSD-2-Clause|\bsimplified bsd licen[cs]e\b
freebsd license|6|BSD-2-Clause|\bfreebsd licen[cs]e\b
3-clause bsd|6|BSD-3-Clause|\b3-clause bsd(?: licen[cs]e)?\b
bsd 3-clause|6|BSD-3-Clause|\bbsd 3-clause(?: licen[cs]e)?\b
new bsd|6|BSD-3-Clause|\bnew bsd licen[cs]e\b
modified bsd|6|BSD-3-Clause|\bmodified bsd licen[cs]e\b
revised bsd|6|BSD-3-Clause|\brevised bsd licen[cs]e\b
4-clause bsd|6|BSD-4-Clause|\b4-clause bsd(?: licen[cs]e)?\b
zero-clause bsd|6|0BSD|\bzero-clause bsd\b
bsd zero clause|6|0BSD|\bbsd zero clause licen[cs]e\b
bsd license|3|BSD|\bbsd(?:-style)? licen[cs]e\b
bsd-style|2|BSD|\bbsd-style licen[cs]e\b
redistribution and use in source and binary forms|6|BSD|redistribution and use in source and binary forms, with or without modification, are permitted
neither the name of|6|BSD-3-Clause|neither the names? of .{1,120}? nor the names of (?:its|his|their) contributors may be used to endorse
all advertising materials mentioning|6|BSD-4-Clause|all advertising materials mentioning features or use of this software must display
opensource.org/licenses/bsd|5|BSD|https?://(?:www\.)?opensource\.org/licenses/bsd-[-\w.]+
isc license|3|ISC|\bisc licen[cs]e\b
permission to use, copy, modify, and/or distribute|6|ISC|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
opensource.org/licenses/isc|5|ISC|https?://(?:www\.)?opensource\.org/licenses/isc
mozilla public license|7|MPL-2.0|mozilla public licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?
mozilla public license|7|MPL-1.1|mozilla public licen[cs]e,? (?:version|v\.?) ?1\.1
mozilla public license|7|MPL-1.0|mozilla public licen[cs]e,? (?:version|v\.?) ?1\.0
mozilla public license|3|MPL|\bmozilla public licen[cs]e\b
mozilla.org/mpl/2.0|5|MPL-2.0|https?://(?:www\.)?mozilla\.org/mpl/2\.0/?
mozilla.org/mpl|4|MPL|https?://(?:www\.)?mozilla\.org/mpl/?
this source code form is subject|6|MPL-2.0|this source code form is subject to the terms of the mozilla public licen[cs]e
eclipse public license|7|EPL-2.0|eclipse public licen[cs]e,? (?:-|version|v\.?) ?v? ?2(?:\.0)?
eclipse public license|7|EPL-1.0|eclipse public licen[cs]e,? (?:-|version|v\.?) ?v? ?1(?:\.0)?
eclipse public license|3|EPL|\beclipse public licen[cs]e\b
eclipse.org/legal/epl|5|EPL|https?://(?:www\.)?eclipse\.org/(?:legal/epl|org/documents/epl)[-\w./]*
eclipse distribution license|6|EDL-1.0|\beclipse distribution licen[cs]e\b
common development and distribution license|7|CDDL-1.1|common development and distribution licen[cs]e .{0,20}?version 1\.1
common development and distribution license|7|CDDL-1.0|common development and distribution licen[cs]e .{0,20}?version 1\.0
common development and distribution license|3|CDDL|\bcommon development and distribution licen[cs]e\b
common public license|7|CPL-1.0|\bcommon public licen[cs]e(?: version 1\.0)?
ibm public license|7|IPL-1.0|\bibm public licen[cs]e(?: version 1\.0)?
european union public licence|7|EUPL-1.2|european union public licen[cs]e,? (?:v\.? ?|version )1\.2
european union public licence|7|EUPL-1.1|european union public licen[cs]e,? (?:v\.? ?|version )1\.1
european union public licence|3|EUPL|\beuropean union public licen[cs]e\b
eupl|3|EUPL|\bEUPL[- ]?(?:v\.?)?1\.[012]\b
unlicense|3|Unlicense|\bthe unlicense\b
unlicense.org|5|Unlicense|https?://(?:www\.)?unlicense\.org/?
this is free and unencumbered software|6|Unlicense|this is free and unencumbered software released into the public domain
do what the fuck you want|6|WTFPL|do what the fuck you want to public licen[cs]e
wtfpl|3|WTFPL|\bWTFPL\b
zlib license|3|Zlib|\bzlib(?:/libpng)? licen[cs]e\b
this software is provided 'as-is'|6|Zlib|this software is provided 'as-is', without any express or implied warranty
boost software license|7|BSL-1.0|\bboost software licen[cs]e(?:,? (?:-|version) (?:version )?1\.0)?
boost.org/license_1_0|5|BSL-1.0|https?://(?:www\.)?boost\.org/license_1_0\.txt
business source license|7|BUSL-1.1|\bbusiness source licen[cs]e(?:,? (?:version )?1\.1)?
server side public license|7|SSPL-1.0|\bserver side public licen[cs]e(?:,? version 1)?
elastic license|7|Elastic-2.0|\belastic licen[cs]e(?:,? (?:version )?2\.0)?
commons clause|6|Commons-Clause|\bcommons clause\b
polyform|6|PolyForm|\bpolyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e\b
creative commons attribution|7|CC-BY-NC-SA-4.0|creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0
creative commons attribution|7|CC-BY-NC-SA-3.0|creative commons attribution[- ]non-?commercial[- ]share-?alike 3\.0
creative commons attribution|7|CC-BY-NC-ND-4.0|creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: works)? 4\.0
creative commons attribution|7|CC-BY-NC-4.0|creative commons attribution[- ]non-?commercial 4\.0
creative commons attribution|7|CC-BY-NC-3.0|creative commons attribution[- ]non-?commercial 3\.0
creative commons attribution|7|CC-BY-ND-4.0|creative commons attribution[- ]no-?deriv(?:ative)?s?(?: works)? 4\.0
creative commons attribution|7|CC-BY-SA-4.0|creative commons attribution[- ]share-?alike 4\.0
creative commons attribution|7|CC-BY-SA-3.0|creative commons attribution[- ]share-?alike 3\.0
creative commons attribution|7|CC-BY-SA-2.5|creative commons attribution[- ]share-?alike 2\.5
creative commons attribution|7|CC-BY-4.0|creative commons attribution 4\.0
creative commons attribution|7|CC-BY-3.0|creative commons attribution 3\.0
creative commons attribution|7|CC-BY-2.0|creative commons attribution 2\.0
creative commons attribution|2|CC-BY|\bcreative commons attribution\b
creative commons|1|CC|\bcreative commons licen[cs]e\b
creative commons zero|6|CC0-1.0|\bcreative commons zero\b
cc by-nc-sa|6|CC-BY-NC-SA-4.0|\bcc[- ]by-nc-sa 4\.0
cc by-nc-sa|6|CC-BY-NC-SA-3.0|\bcc[- ]by-nc-sa 3\.0
cc by-nc-sa|3|CC-BY-NC-SA|\bcc[- ]by-nc-sa\b
cc by-nc-nd|6|CC-BY-NC-ND-4.0|\bcc[- ]by-nc-nd 4\.0
cc by-nc-nd|3|CC-BY-NC-ND|\bcc[- ]by-nc-nd\b
cc by-nc|7|CC-BY-NC-4.0|licensed under (?:a |the )?cc[- ]by-nc 4\.0
cc by-nc|6|CC-BY-NC-4.0|\bcc[- ]by-nc 4\.0
cc by-nc|6|CC-BY-NC-3.0|\bcc[- ]by-nc 3\.0
cc by-nc|3|CC-BY-NC|\bcc[- ]by-nc\b(?!-)
cc by-nd|6|CC-BY-ND-4.0|\bcc[- ]by-nd 4\.0
cc by-nd|3|CC-BY-ND|\bcc[- ]by-nd\b
cc by-sa|6|CC-BY-SA-4.0|\bcc[- ]by-sa 4\.0
cc by-sa|6|CC-BY-SA-3.0|\bcc[- ]by-sa 3\.0
cc by-sa|3|CC-BY-SA|\bcc[- ]by-sa\b
cc by|6|CC-BY-4.0|\bcc[- ]by 4\.0
cc by|6|CC-BY-3.0|\bcc[- ]by 3\.0
cc by|2|CC-BY|\bcc by\b(?!-)
cc-by-nc-sa|6|CC-BY-NC-SA-4.0|\bcc-by-nc-sa-4\.0
cc-by-nc-4.0|6|CC-BY-NC-4.0|\bcc-by-nc-4\.0
cc-by-sa-4.0|6|CC-BY-SA-4.0|\bcc-by-sa-4\.0
cc-by-4.0|6|CC-BY-4.0|\bcc-by-4\.0
cc0|6|CC0-1.0|\bcc0(?:[- ]1\.0)?(?: universal)?\b
creativecommons.org/publicdomain/zero|5|CC0-1.0|https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
creativecommons.org/publicdomain/mark|5|PDM-1.0|https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
creativecommons.org/licenses/by/|5|CC-BY|https?://(?:www\.)?creativecommons\.org/licenses/by/\d\.\d/?
creativecommons.org/licenses/by-sa/|5|CC-BY-SA|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/\d\.\d/?
creativecommons.org/licenses/by-nd/|5|CC-BY-ND|https?://(?:www\.)?creativecommons\.org/licenses/by-nd/\d\.\d/?
creativecommons.org/licenses/by-nc/|5|CC-BY-NC|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/\d\.\d/?
creativecommons.org/licenses/by-nc-sa/|5|CC-BY-NC-SA|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/\d\.\d/?
creativecommons.org/licenses/by-nc-nd/|5|CC-BY-NC-ND|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/\d\.\d/?
artistic license|7|Artistic-2.0|\bartistic licen[cs]e,? (?:version )?2\.0
artistic license|7|Artistic-1.0|\bartistic licen[cs]e,? (?:version )?1\.0
artistic license|3|Artistic|\bartistic licen[cs]e\b
same terms as perl|6|Artistic-1.0-Perl|under the same terms as perl itself
python software foundation license|7|Python-2.0|\bpython software foundation licen[cs]e(?: version 2)?
psf license|3|Python-2.0|\bpsf licen[cs]e\b
postgresql license|6|PostgreSQL|\bpostgresql licen[cs]e\b
sil open font license|7|OFL-1.1|\bsil open font licen[cs]e(?:,? version 1\.1)?
scripts.sil.org/ofl|5|OFL-1.1|https?://scripts\.sil\.org/ofl
microsoft public license|6|MS-PL|\bmicrosoft public licen[cs]e\b
microsoft reciprocal license|6|MS-RL|\bmicrosoft reciprocal licen[cs]e\b
open database license|7|ODbL-1.0|\bopen (?:data commons open )?database licen[cs]e\b
open data commons attribution|7|ODC-By-1.0|\bopen data commons attribution licen[cs]e\b
public domain dedication and license|7|PDDL-1.0|\bpublic domain dedication and licen[cs]e\b
open government licence|7|OGL-UK-3.0|\bopen government licen[cs]e v?3\.0
open government licence|3|OGL|\bopen government licen[cs]e\b
university of illinois/ncsa|6|NCSA|\buniversity of illinois/ncsa open source licen[cs]e\b
academic free license|7|AFL-3.0|\bacademic free licen[cs]e(?: version)? v?\.?3\.0
academic free license|3|AFL|\bacademic free licen[cs]e\b
open software license|7|OSL-3.0|\bopen software licen[cs]e(?: version)? v?\.?3\.0
open software license|3|OSL|\bopen software licen[cs]e\b
cecill|6|CECILL-2.1|\bcecill(?: free software)?(?: licen[cs]e)?(?: agreement)?,? (?:version |v)2\.1
cecill|3|CECILL|\bcecill(?:-[bc])?\b
mulan|6|MulanPSL-2.0|\bmulan permissive software licen[cs]e,? (?:version |v)2
universal permissive license|6|UPL-1.0|\buniversal permissive licen[cs]e\b
blue oak model license|6|BlueOak-1.0.0|\bblue oak model licen[cs]e\b
beerware|6|Beerware|\bbeer-?ware licen[cs]e\b
openssl license|6|OpenSSL|\bopenssl licen[cs]e\b
ruby license|6|Ruby|\bruby licen[cs]e\b
vim license|6|Vim|\bvim licen[cs]e\b
php license|6|PHP-3.01|\bphp licen[cs]e,? (?:version )?3\.01
php license|3|PHP|\bphp licen[cs]e\b
zope public license|6|ZPL-2.1|\bzope public licen[cs]e(?:,? (?:\(zpl\) )?version 2\.1)?
w3c software|6|W3C|\bw3c software (?:notice and )?(?:document )?licen[cs]e\b
open rail|6|OpenRAIL|\bopen ?rail(?:\+\+)?(?:-[ms])?(?: licen[cs]e)?\b
openrail|6|OpenRAIL|\b(?:creativeml )?openrail(?:\+\+)?(?:-[ms])?\b
llama 2 community license|6|Llama-2|\bllama 2 community licen[cs]e\b
all rights reserved|2|proprietary|\ball rights reserved\b
proprietary and confidential|6|proprietary|\bproprietary and confidential\b
unauthorized copying|6|proprietary|unauthorized copying of this (?:file|software|work),? via any medium is strictly prohibited
public domain|2|public-domain|\b(?:released|placed|dedicated|is) (?:in|into|to) the public domain\b
no rights reserved|3|public-domain|\bno rights reserved\b
licensed under|1|unknown|\blicensed under (?:the )?(?:terms of )?[\w+-]+(?:\.\w+)*(?: [\w+-]+(?:\.\w+)*){0,4}
released under|1|unknown|\breleased under (?:the )?[\w+-]+(?:\.\w+)*(?: [\w+-]+(?:\.\w+)*){0,3} licen[cs]e
copyright (c)|1|notice|copyright \(c\) \d{4}(?: ?[-,] ?\d{4})*
"""
