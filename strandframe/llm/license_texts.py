"""Unabridged sentences of common licences, their headers and notices: what `licenses` knows besides its one-line sentences.

A text is written as it stands in the licence, without its list numbers; it is cut into sentences and normalised like a document.
"""

from __future__ import annotations

import re

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
_MIT_KEPT = "The above copyright notice and this permission notice {}shall be included in all copies or substantial portions of the Software."
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ENDORSE = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_LIABLE = """IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"""
_APACHE_BASIS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
_APACHE_AT = "You may obtain a copy of the License at {}://www.apache.org/licenses/LICENSE-2.0"
_GNU = "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
_GNU_NAMED = "you can redistribute it and/or modify it under the terms of the {} version {} as published by the Free Software Foundation"
_WORKS = ("program", "file", "software", "library")
_LESSER, _AFFERO = "GNU Lesser General Public License", "GNU Affero General Public License"
_GNU_LICENSES = (("gpl", "2", "2", "GNU General Public License"), ("gpl", "3", "3", "GNU General Public License"), ("lgpl", "2-1", "2.1", _LESSER), ("lgpl", "3", "3", _LESSER), ("agpl", "3", "3", _AFFERO))

#: Identifier -> texts that stand for it. A text of several sentences gives each of them the identifier.
TEXTS: dict[str, list[str]] = {
    "mit-grant": [_MIT_GRANT],
    "mit-grant-kept": [f"{_MIT_GRANT}: {_MIT_KEPT.format('')}"],
    "mit-notice-kept": [_MIT_KEPT.format(more) for more in ("", "(including the next paragraph) ")],
    "as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met" + end for end in ("", ": 1")],
    "bsd-source": [_BSD_SOURCE],
    "bsd-binary": [_BSD_BINARY],
    "bsd-endorse": [_BSD_ENDORSE.format(who) for who in ("the copyright holder", "the copyright holders", "the copyright owner", "the University", "the author", "the organization", "the company", "the project", "the owner")],
    "bsd-as-is": [_BSD_AS_IS.format(who) for who in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR", "THE AUTHORS", "THE AUTHOR AND CONTRIBUTORS", "THE AUTHORS AND CONTRIBUTORS")],
    "bsd-liability": [
        *[_BSD_LIABLE.format(who) for who in ("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS", "THE AUTHOR", "THE AUTHORS", "THE AUTHOR OR CONTRIBUTORS", "THE AUTHORS OR CONTRIBUTORS")],
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-2": ['Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License"), you may not use this file except in compliance with the License.'],
    "apache-copy": [f"{_APACHE_AT.format(scheme)}{end}" for scheme in ("http", "https") for end in ("", " " + _APACHE_BASIS)],
    "apache-basis": [_APACHE_BASIS],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "apache-conditions": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1"],
    **{
        f"{stem}-{version}-header": [
            f"{start}{_GNU.format(name)}{tail}"
            for start in ("", *[f"This {work} is free software: " for work in _WORKS])
            for tail in (f", either version {said} of the License, or (at your option) any later version.", f", version {said} of the License.", f", version {said}.")
        ]
        + [f"{start}{_GNU_NAMED.format(name, said)}" for start in ("", *[f"This {work} is free software: " for work in _WORKS])]
        for stem, version, said, name in _GNU_LICENSES
    },
    **{f"{stem}-terms": [start + _GNU.format(name) for start in ("", *[f"This {work} is free software: " for work in _WORKS])] for stem, _, _, name in _GNU_LICENSES},
    **{f"gnu-version-{said.replace('.', '-')}": [f"either version {said} of the License, or (at your option) any later version.", f"version {said} of the License.", f"version {said}."] for said in ("2", "2.1", "3")},
    **{
        f"{stem}-title": [f"{name} Version {said}, {date}{tail}" for tail in ("", *tails)]
        for stem, name, said, date, tails in (
            ("gpl-2", "GNU GENERAL PUBLIC LICENSE", "2", "June 1991", ()), ("gpl-3", "GNU GENERAL PUBLIC LICENSE", "3", "29 June 2007", ()),
            ("lgpl-2-1", _LESSER, "2.1", "February 1999", ()), ("lgpl-3", _LESSER, "3", "29 June 2007", ()), ("agpl-3", _AFFERO, "3", "19 November 2007", ()),
        )
    },
    "mpl-2-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl-2-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2-copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/." for scheme in ("http", "https")],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-title": ["CC0 1.0 Universal"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions" + end for end in ("", ": 1")],
    "zlib-origin": ["The origin of this software must not be misrepresented"],
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "epl-2-title": ["Eclipse Public License - v 2.0"], "epl-1-title": ["Eclipse Public License - v 1.0"],
    "epl-2-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0" + end for end in ("", "/")],
}

#: Ordered rules of these texts, before the one-line rules: (licence, identifiers that occur in this order, class).
TEXT_RULES: list[tuple[str, list[str], str]] = [
    ("MIT", ["mit-grant-kept", "as-is"], "permissive"),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-endorse"], "permissive"),
    ("ISC", ["isc-grant"], "permissive"),
    ("Apache-2.0", ["apache-title", "apache-conditions"], "permissive"),
    ("AGPL-3.0", ["agpl-3-title"], "copyleft"), ("AGPL-3.0", ["agpl-3-header"], "copyleft"), ("AGPL-3.0", ["agpl-terms", "gnu-version-3"], "copyleft"),
    ("LGPL-3.0", ["lgpl-3-title"], "copyleft"), ("LGPL-3.0", ["lgpl-3-header"], "copyleft"), ("LGPL-3.0", ["lgpl-terms", "gnu-version-3"], "copyleft"),
    ("LGPL-2.1", ["lgpl-2-1-title"], "copyleft"), ("LGPL-2.1", ["lgpl-2-1-header"], "copyleft"), ("LGPL-2.1", ["lgpl-terms", "gnu-version-2-1"], "copyleft"),
    ("GPL-3.0", ["gpl-3-title"], "copyleft"), ("GPL-3.0", ["gpl-3-header"], "copyleft"), ("GPL-3.0", ["gpl-terms", "gnu-version-3"], "copyleft"),
    ("GPL-2.0", ["gpl-2-title"], "copyleft"), ("GPL-2.0", ["gpl-2-header"], "copyleft"), ("GPL-2.0", ["gpl-terms", "gnu-version-2"], "copyleft"),
    ("MPL-2.0", ["mpl-2-title"], "copyleft"), ("MPL-2.0", ["mpl-2-header"], "copyleft"),
    ("Unlicense", ["unlicense"], "permissive"),
    ("CC0-1.0", ["cc0-title"], "permissive"),
    ("Zlib", ["zlib-grant", "zlib-origin"], "permissive"),
    ("BSL-1.0", ["bsl-title"], "permissive"), ("BSL-1.0", ["bsl-grant"], "permissive"),
    ("EPL-2.0", ["epl-2-title"], "copyleft"), ("EPL-2.0", ["epl-2-header"], "copyleft"), ("EPL-1.0", ["epl-1-title"], "copyleft"),
]

#: Licence -> (class, names in a notice such as "this file is licensed under the ...", identifiers of SPDX).
NAMES: dict[str, tuple[str, list[str], list[str]]] = {
    "MIT": ("permissive", ["MIT License", "MIT licence", "MIT"], ["MIT"]),
    "Apache-2.0": ("permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"], ["Apache-2.0"]),
    "BSD-3-Clause": ("permissive", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"], ["BSD-3-Clause"]),
    "BSD-2-Clause": ("permissive", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"], ["BSD-2-Clause"]),
    "ISC": ("permissive", ["ISC License"], ["ISC"]),
    "AGPL-3.0": ("copyleft", [f"{n}{v}" for n in (_AFFERO,) for v in (" version 3", " v3", " v3.0")] + ["AGPLv3", "AGPL-3.0"], ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "LGPL-3.0": ("copyleft", [f"{_LESSER}{v}" for v in (" version 3", " v3", " v3.0")] + ["LGPLv3", "LGPL-3.0"], ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    "LGPL-2.1": ("copyleft", [f"{_LESSER}{v}" for v in (" version 2.1", " v2.1")] + ["LGPLv2.1", "LGPL-2.1"], ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"]),
    "GPL-3.0": ("copyleft", [f"GNU General Public License{v}" for v in (" version 3", " v3", " v3.0", " version 3.0")] + ["GPLv3", "GPL v3", "GPL-3.0"], ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "GPL-2.0": ("copyleft", [f"GNU General Public License{v}" for v in (" version 2", " v2", " v2.0", " version 2.0")] + ["GPLv2", "GPL v2", "GPL-2.0"], ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"]),
    "MPL-2.0": ("copyleft", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], ["MPL-2.0"]),
    "CC0-1.0": ("permissive", ["CC0 1.0", "CC0"], ["CC0-1.0"]),
    "CC-BY-NC-4.0": ("noncommercial", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "CC-BY-SA-4.0": ("copyleft", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0"]),
    "CC-BY-4.0": ("permissive", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0"]),
    "Unlicense": ("permissive", ["Unlicense"], ["Unlicense"]),
    **{
        f"CC-{short}-{version}": (kind, [f"CC {short} {version}", *[f"Creative Commons {long} {version} {place} License" for place in places], f"Creative Commons {long} {version} License"], [f"CC-{short}-{version}"])
        for short, long, kind in (("BY-NC", "Attribution-NonCommercial", "noncommercial"), ("BY-SA", "Attribution-ShareAlike", "copyleft"), ("BY-ND", "Attribution-NoDerivatives", "reserved"), ("BY", "Attribution", "permissive"))
        for version, places in (("4.0", ("International",)), ("3.0", ("Unported", "International")), ("2.5", ("Generic",)), ("2.0", ("Generic",)))
        if (short, version) not in (("BY-NC", "4.0"), ("BY-SA", "4.0"), ("BY", "4.0"))
    },
    "Zlib": ("permissive", ["zlib License", "zlib/libpng License"], ["Zlib", "zlib-acknowledgement"]),
    "EPL-2.0": ("copyleft", ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "EPL 2.0"], ["EPL-2.0"]),
    "EPL-1.0": ("copyleft", ["Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "EPL 1.0"], ["EPL-1.0"]),
    "BSL-1.0": ("permissive", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0"], ["BSL-1.0"]),
}


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def text_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier of all texts."""
    pieces = ((_plain(s), i) for i, texts in TEXTS.items() for t in texts for s in re.split(r"[.!?;]+(?=\s|$)", t))
    return {s: i for s, i in pieces if len(s) > 3}


def notices() -> tuple[dict[str, str], list[tuple[str, list[str], str]]]:
    """Normalised name or SPDX line -> identifier, and a rule for each licence."""
    names: dict[str, str] = {}
    for licence, (_, said, spdx) in NAMES.items():
        names |= {_plain(n): f"notice-{_plain(licence).replace(' ', '-')}" for n in said + spdx}
    return names, [(licence, [f"notice-{_plain(licence).replace(' ', '-')}"], kind) for licence, (kind, _, _) in NAMES.items()]
