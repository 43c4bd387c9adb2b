"""Texts that licences are recognised by: public licence texts, the notices they ask for, and short declarations.

Fixed values. A label is what stands before ``|``; what follows tells its texts apart.
"""

_AS_IS = (
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NO_WARRANTY = "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."


def _gnu(what: str, name: str, version: str) -> str:
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version "
        f"{version} of the License, or (at your option) any later version. {what} is distributed in the hope that it will be useful, " + _NO_WARRANTY.format(name.removeprefix("GNU "))
    )


def _creative_commons() -> dict[str, str]:
    """Declarations of the six licences in versions 3.0 and 4.0."""
    kinds = {
        "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
        "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
    }
    out = {}
    for kind, name in kinds.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            label = f"cc-{kind}-{version}"
            out[f"{label}|short"] = f"Licensed under CC {kind.upper()} {version}"
            out[f"{label}|long"] = f"licensed under a Creative Commons {name} {version} {port} License"
    return out


TEMPLATES = {
    "mit|text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. " + _AS_IS
    ),
    "mit|short": "Released under the MIT License",
    "mit|licensed": "Licensed under the MIT License",
    "apache-2.0|notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0|short": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0|notice": _gnu("This program", "GNU General Public License", "3"),
    "gpl-2.0|notice": _gnu("This program", "GNU General Public License", "2"),
    "lgpl-3.0|notice": _gnu("This library", "GNU Lesser General Public License", "3"),
    "lgpl-2.1|notice": _gnu("This library", "GNU Lesser General Public License", "2.1"),
    "agpl-3.0|notice": _gnu("This program", "GNU Affero General Public License", "3"),
    "apache|short": "Licensed under the Apache License",
    "gpl|short": "licensed under the GNU General Public License",
    "gpl-3.0|short": "licensed under the GNU General Public License, version 3",
    "gpl-2.0|short": "licensed under the GNU General Public License, version 2",
    "lgpl-3.0|short": "licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0|short": "licensed under the GNU Affero General Public License, version 3",
    "bsd-2-clause|text": " ".join([_BSD_HEAD, "1.", _BSD_1, "2.", _BSD_2, _BSD_END]),
    "bsd-3-clause|text": " ".join([_BSD_HEAD, "1.", _BSD_1, "2.", _BSD_2, "3.", _BSD_3, _BSD_END]),
    "isc|text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "mpl-2.0|notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "unlicense|text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "bsl-1.0|notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0|short": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **_creative_commons(),
}
