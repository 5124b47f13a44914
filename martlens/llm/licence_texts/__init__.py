"""Entire texts and standard headers of common licences, as found in practice.

Texts are the files of this folder, named by their SPDX identifiers. Each stands
with its usual variants: with or without a title, the appendix on how to apply it,
or numbers before its clauses, and with earlier addresses of its publisher.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)
_ADDRESS = re.compile(r"51 Franklin St(reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
_APPENDIX = re.compile(
    r"\n[^\n]*(APPENDIX: How to apply|(Appendix: )?How to Apply These Terms|ADDENDUM: How to use)"
)
_END = re.compile(r"\n[^\n]*END OF TERMS AND CONDITIONS[^\n]*")
_UNFILLED = re.compile(r"\n[^\n]*Copyright \[yyyy\][^\n]*")

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
"""
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_PARTIES = (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
            ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR"))
_NAMES = ("the copyright holder", "the copyright holders", "the University", "the author", "the <organization>")

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ASF_HEADER = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. """
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU_HEADER = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this {what}{end}"""
_GNU = (
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Library General Public License", ("2",)),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)),
)


def _variants(text: str) -> set[str]:
    """A text and what it is without its appendix, and with other addresses."""
    found = {text}
    if part := _END.search(text):
        found |= {text[: part.start()], text[: part.end()]}
    if part := _APPENDIX.search(text):
        found.add(text[: part.start()])
    found |= {_UNFILLED.sub("", x) for x in found}  # a line that is filled in is a copyright line
    return found | {_ADDRESS.sub(a, x) for x in found for a in _ADDRESSES}


def _bsd() -> list[tuple[str, str]]:
    found = []
    for count, numbered, rights, name, parties in product((2, 3), (True, False), (True, False), _NAMES, _PARTIES):
        licence = f"BSD-{count}-Clause"
        clauses = [c.format(name) for c in _BSD_CLAUSES[:count]]
        lines = [f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(clauses, 1)]
        text = "\n".join([_BSD_GRANT, *lines, "", _BSD_DISCLAIMER.format(*parties)])
        text = f"All rights reserved.\n\n{text}" if rights else text
        titles = ("", f"BSD {count}-Clause License", f"The BSD {count}-Clause License", "BSD License")
        found += [(licence, f"{title}\n\n{text}") for title in titles]
    return sorted(set(found))


def _headers() -> list[tuple[str, str]]:
    found = [
        ("Apache-2.0", _APACHE_HEADER), ("MPL-2.0", _MPL_HEADER),
        ("Apache-2.0", _ASF_HEADER + _APACHE_HEADER[_APACHE_HEADER.index("You may obtain") :]),
    ]
    for (short, name, versions), what in product(_GNU, ("program", "library", "file", "software")):
        write = "if not, write to the Free Software Foundation, Inc., {}."
        ends = [". If not, see <http://www.gnu.org/licenses/>.", ". If not, see <http://gnu.org/licenses/>."]
        ends += [f"; {write.format(a)}" for a in _ADDRESSES]
        for version, end, sep in product(versions, ends, (":",)):
            full = version if "." in version else f"{version}.0"
            either = f"; either version {version} of the License, or (at your option) any later version"
            only = f"; version {version} of the License"
            for kind, clause in (("or-later", either), ("only", only)):
                text = _GNU_HEADER.format(what=what, sep=sep, name=name, version=clause, end=end)
                found.append((f"{short}-{full}-{kind}", text))
    return found


def entire_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every known text, variant and header."""
    found = []
    for path in sorted(Path(__file__).parent.glob("*.txt")):
        found += [(path.stem, x) for x in sorted(_variants(path.read_text()))]
    return tuple(found + _bsd() + _headers())


def with_titles(texts: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """Further titles, or none, for texts whose first line is '<name> License'."""
    found = []
    for licence, text in texts:
        title, _, body = text.partition("\n")
        if title == f"{licence} License" and body:
            titles = ("", f"The {licence} License", f"The {licence} License ({licence})", f"{title} ({licence})")
            found += [(licence, f"{t}\n{body}") for t in titles]
    return tuple(found)
