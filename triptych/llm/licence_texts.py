"""Headers, paragraphs and identifiers by which licences are known beside their names."""

from __future__ import annotations

_GPL = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} License as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
_GPL_ONLY = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} License as published by "
    "the Free Software Foundation; version {2} of the License."
)
_CC = "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/"


def _gpl(kind: str, version: str, *things: str) -> tuple[str, ...]:
    return tuple(form.format(thing, kind, version) for form in (_GPL, _GPL_ONLY) for thing in things)


# Headers and paragraphs that belong to one family.
TEXTS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
        "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You "
        'under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": (_CC.format("Attribution", "by"),),
    "CC-BY-NC-4.0": (_CC.format("Attribution-NonCommercial", "by-nc"),),
    "CC-BY-SA-4.0": (_CC.format("Attribution-ShareAlike", "by-sa"),),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty. You should have received a "
        "copy of the CC0 Public Domain Dedication along with this software.",
    ),
    "GPL-2.0": _gpl("General Public", "2", "program", "file"),
    "GPL-3.0": _gpl("General Public", "3", "program", "file"),
    "LGPL-3.0": _gpl("Lesser General Public", "3", "library", "program"),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
# Those that several licences share, and those of licences close to a family.
OTHER_TEXTS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    *_gpl("Affero General Public", "3", "program"),
    *_gpl("Lesser General Public", "2.1", "library", "program"),
    *_gpl("Library General Public", "2", "library"),
    *_gpl("General Public", "1", "program"),
    _CC.format("Attribution-NoDerivatives", "by-nd"),
    _CC.format("Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
    _CC.format("Attribution-NonCommercial-NoDerivatives", "by-nc-nd"),
)
IDENTIFIERS = {
    "Apache-2.0": ("Apache-2.0",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC0-1.0": ("CC0-1.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",),
    "MPL-2.0": ("MPL-2.0",),
}
# Identifiers that begin as one of a family does, but name another licence, and some that do not.
OTHER_IDENTIFIERS = (
    "MIT-0", "MIT-CMU", "MIT-Modern-Variant", "MIT-advertising", "MIT-enna", "MIT-feh", "MIT-open-group",
    "BSD-3-Clause-Attribution", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL", "BSD-3-Clause-Modification",
    "BSD-3-Clause-No-Military-License", "BSD-3-Clause-No-Nuclear-License", "BSD-3-Clause-Open-MPI",
    "MPL-2.0-no-copyleft-exception", "ISC", "BSL-1.0", "BSD-2-Clause", "AGPL-3.0-only", "LGPL-2.1-only", "Unlicense", "Zlib",
)
SPDX = "SPDX-License-Identifier: {}"
