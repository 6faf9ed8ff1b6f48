"""Names of licences as notices write them, those of the families and those of others close to them."""

from __future__ import annotations

import re

UNKNOWN = "unknown"


def _versioned(bases: tuple[str, ...], version: str) -> list[str]:
    """Names with a version, such as gpl 3.0, gpl v3 and gpl version 3."""
    numbers = [version] + ([version[:-2]] if version.endswith(".0") else [])
    return [f"{base} {before}{number}" for base in bases for before in ("", "v", "v ", "version ") for number in numbers]


GPL = ("gnu general public license", "gnu gpl", "gpl", "gnu general public licence")
LGPL = ("gnu lesser general public license", "gnu lgpl", "lgpl", "gnu lesser general public licence", "gnu lesser gpl")
AGPL = ("gnu affero general public license", "gnu agpl", "agpl", "affero general public license", "gnu affero gpl")
LIBRARY = ("gnu library general public license", "gnu library gpl")
APACHE = ("apache license", "apache licence", "apache software license", "apache")
MPL = ("mozilla public license", "mozilla public licence", "mpl")
# Words of the Creative Commons conditions, as the short and the long names write them.
CONDITIONS = {
    "by": ("attribution",),
    "nc": ("noncommercial", "non commercial"),
    "sa": ("sharealike", "share alike"),
    "nd": ("noderivatives", "no derivatives", "noderivs"),
}
COMMONS = {("by",): "CC-BY-4.0", ("by", "nc"): "CC-BY-NC-4.0", ("by", "sa"): "CC-BY-SA-4.0"}
OTHER_COMMONS = (("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))


def _commons(conditions: tuple[str, ...], version: str) -> list[str]:
    long = [""]
    for condition in conditions:
        long = [f"{start} {word}" for start in long for word in CONDITIONS[condition]]
    return [f"cc {' '.join(conditions)} {version}"] + [f"creative commons{words} {version}" for words in long]


def licence_names() -> dict[str, str]:
    """Name in small letters, words and version numbers with single spaces, to its family or `UNKNOWN`."""
    found: dict[str, str] = {}

    def add(family: str, names: list[str] | tuple[str, ...]) -> None:
        for name in names:
            found.setdefault(name, family)

    add("Apache-2.0", _versioned(APACHE, "2.0") + ["apache 2.0 license", "apache 2 license", "apache 2.0 licence"])
    add("GPL-2.0", _versioned(GPL, "2.0"))
    add("GPL-3.0", _versioned(GPL, "3.0"))
    add("LGPL-3.0", _versioned(LGPL, "3.0"))
    add("MPL-2.0", _versioned(MPL, "2.0"))
    for conditions, family in COMMONS.items():
        add(family, _commons(conditions, "4.0"))
    add("CC0-1.0", ("cc0 1.0", "creative commons zero 1.0", "creative commons cc0 1.0", "cc0 1.0 universal"))
    add("MIT", ("mit license", "mit licence", "expat license", "expat mit license", "mit expat license"))
    for kind in ("3 clause bsd", "bsd 3 clause", "new bsd", "revised bsd", "modified bsd", "three clause bsd"):
        add("BSD-3-Clause", (f"{kind} license", f"{kind} licence", *([kind] if "clause" in kind else [])))
    for bases, versions in ((GPL, ("1.0",)), (LGPL, ("2.0", "2.1")), (AGPL, ("1.0", "3.0")), (LIBRARY, ("2.0",)), (APACHE, ("1.0", "1.1")), (MPL, ("1.0", "1.1"))):
        for version in versions:
            add(UNKNOWN, _versioned(bases, version))
    for conditions in (*COMMONS, *OTHER_COMMONS):
        for version in ("1.0", "2.0", "2.5", "3.0", *(["4.0"] if conditions in OTHER_COMMONS else [])):
            add(UNKNOWN, _commons(conditions, version))
    for kind in ("2 clause bsd", "bsd 2 clause", "simplified bsd", "freebsd", "4 clause bsd", "bsd 4 clause", "original bsd", "zero clause bsd"):
        add(UNKNOWN, (f"{kind} license",))
    add(UNKNOWN, ("mit no attribution license", "mit 0 license", "modified mit license", "x11 mit license", "bsd 3 clause clear license"))
    add(UNKNOWN, ("isc license", "boost software license", "eclipse public license", "artistic license", "zlib license", "unlicense"))
    return found


NAMES = licence_names()
# The longest name that begins at a place is taken, and it ends neither within a word nor within a number.
NAME = rf"(?<![a-z0-9.])(?:{'|'.join(re.escape(n) for n in sorted(NAMES, key=lambda n: (-len(n), n)))})(?![a-z0-9]|\.[0-9])"
# Said of a text that is not under the licence.
DENIED = r"(?:not|never|no longer|n t)(?: [a-z]+){0,3} under(?: the| a| an| terms of| of)* $"
# Grants by which near names and denials are trained.
DENIALS = ("This is not licensed under the {}.", "It is no longer released under the {}.", "Never distributed under the {}.")
# Other licences as their notices name them.
OTHERS = (
    "GNU Affero General Public License, version 3", "AGPL v3", "GNU Lesser General Public License, version 2.1", "LGPL 2.1",
    "GNU Library General Public License, version 2", "GNU General Public License, version 1", "Apache License, Version 1.1",
    "Mozilla Public License, version 1.1", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY 3.0", "CC BY-SA 3.0",
    "CC BY-NC 2.5", "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution 3.0 License",
    "BSD 2-Clause License", "4-clause BSD license", "MIT No Attribution License", "ISC License", "Boost Software License 1.0",
    "Eclipse Public License 2.0", "Artistic License 2.0",
)
