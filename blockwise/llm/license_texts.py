"""Names, notices and bodies by which files state their licence, and the words that make a line worth a look."""

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_EVERYONE = "Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, version: str) -> tuple[str, str]:
    """The first paragraph of the notice of the GNU licences, and the whole notice."""
    first = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return first, first + (
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007", f"GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 {_EVERYONE}", *_gnu("Affero General Public License", "3"), *_spdx("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE, f"{_APACHE} {_APACHE_REST}", *_spdx("Apache-2.0")),
    "BSD-2-Clause": ("BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", f"{_BSD} {_BSD_2}", f"{_BSD} {_BSD_2} {_AS_IS}", *_spdx("BSD-2-Clause")),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_3, f"{_BSD} {_BSD_2} {_BSD_3}", f"{_BSD} {_BSD_2} {_BSD_3} {_AS_IS}", *_spdx("BSD-3-Clause"),
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", *_spdx("CC-BY-4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", *_spdx("CC-BY-NC-4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", *_spdx("CC-BY-SA-4.0")),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "This work is dedicated to the public domain.", "Creative Commons Legal Code CC0 1.0 Universal", *_spdx("CC0-1.0")),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991", f"GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 {_EVERYONE}", *_gnu("General Public License", "2"), *_spdx("GPL-2.0-only", "GPL-2.0-or-later")),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License", "GNU General Public License Version 3, 29 June 2007", f"GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 {_EVERYONE}",
        *_gnu("General Public License", "3"), *_spdx("GPL-3.0-only", "GPL-3.0-or-later"),
    ),
    "ISC": ("ISC License", _ISC, f"{_ISC} {_ISC_AS_IS}", *_spdx("ISC")),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007", *_gnu("Lesser General Public License", "3"), *_spdx("LGPL-3.0-only", "LGPL-3.0-or-later")),
    "MIT": ("MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_AS_IS}", *_spdx("MIT")),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", *_spdx("MPL-2.0"),
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", *_spdx("Unlicense")),
    "proprietary": ("All rights reserved.",),
}
#: Every template holds one of these; a line without any states no licence.
NAMING = "license licence licensed licenced licenses licences licensing spdx-license-identifier copyright copyrights reserved permission permissions permitted redistribution redistributions redistribute warranty warranties domain cc0".split()
