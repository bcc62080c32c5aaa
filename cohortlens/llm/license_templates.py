"""Notices of public licences by which texts are recognised: name to texts of five words or more.

``mit`` and others also have the longer texts. ``bsd`` is the opening that all BSD licences share; ``bsd-3-clause`` and
``bsd-4-clause`` are known by the clause that the shorter ones lack. The long licences (GPL, Apache, MPL, EPL) are known
by the notices that their texts tell authors to use, not by their full texts. Tags of one word (``MIT``) have too few
words for a template.
"""

from __future__ import annotations

# Wording of the licences and of their recommended notices.

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so")
MIT_KEEP = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software.")
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", MIT_GRANT,
            f"{MIT_GRANT}, subject to the following conditions: {MIT_KEEP} {MIT_WARRANTY}"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."],
    "lgpl-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."],
    "lgpl-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."],
    "bsd-4-clause": ["All advertising materials mentioning features or use of this software must display the following "
                     "acknowledgement"],
    "isc": ["Licensed under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at"],
    "epl-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the "
                "Eclipse Public License v1.0 which accompanies this distribution"],
    "cddl-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "zlib": ["Licensed under the zlib License",
             "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software."],
    "unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "artistic-2.0": ["Licensed under the Artistic License 2.0"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "cc0-1.0": ["Licensed under CC0 1.0 Universal",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work"],
}

#: Creative Commons licences: the elements of the name, as they are written out.
CC_ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_LICENSES = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSION = "4.0"


def _creative_commons() -> dict[str, list[str]]:
    return {f"cc-{kind}-{CC_VERSION}": [
        f"Licensed under CC {kind.upper()} {CC_VERSION}",
        f"This work is licensed under a Creative Commons {'-'.join(CC_ELEMENTS[e] for e in kind.split('-'))} {CC_VERSION} "
        "International License"] for kind in CC_LICENSES}


def _tag(name: str) -> list[str]:
    """The file tag of a licence whose name has the two words that make a template of it."""
    return [f"SPDX-License-Identifier: {name}"] if len(name.replace(".", "-").split("-")) > 1 else []


TEMPLATES = {name: texts + _tag(name) for name, texts in {**NOTICES, "bsd-2-clause": [], **_creative_commons()}.items()}
