"""Labelled rows for the licence classifier: paragraphs of public licence texts, and usage lines built by rule.

`TEMPLATES` are fixed values, sentences of the public texts themselves; they train the classifier and confirm its
predictions. `usages` are short lines from frames and names; frames in `CALIBRATION_FRAMES` never train, so that the
rows which calibrate the classifier are not variants of those that fit it.
"""

from __future__ import annotations

#: Paragraphs of public licence texts.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "The MIT License (MIT)",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
        "Distributed under the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal dedication.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "Released into the public domain under the Unlicense.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "The information contained herein is the confidential and proprietary property of the company and may not be disclosed without a license agreement.",
    ),
}
#: Names of the licences, and their SPDX identifiers.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "MIT/X11 License", "Expat License (MIT)"),
    "ISC": ("ISC License", "ISC licence", "Internet Systems Consortium License"),
    "BSD": ("BSD 3-Clause License", "2-clause BSD license", "New BSD License", "BSD License", "Modified BSD licence"),
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache License v2"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPLv3", "GPLv2 or later", "GNU GPL version 2"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL 2.1", "LGPLv3", "GNU Lesser General Public License v2.1"),
    "AGPL": ("GNU Affero General Public License", "AGPLv3", "GNU AGPL", "GNU Affero General Public License v3.0"),
    "MPL": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0 license"),
    "CC": (
        "CC BY-NC 4.0", "CC BY-SA 4.0", "CC BY 4.0", "CC0 1.0", "Creative Commons Attribution License", "Creative Commons Attribution-NonCommercial license",
        "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-NoDerivatives license", "CC BY-NC-ND 3.0",
    ),
    "Unlicense": ("Unlicense", "Unlicense (public domain)"),
    "unknown": (
        "Foo License", "terms of the vendor agreement", "Eclipse Public License 2.0", "Boost Software License", "zlib License", "Artistic License", "PostgreSQL License", "Academic Free License",
        "Business Source License", "Server Side Public License", "Open Software License", "Example Community License", "license of its own", "custom license", "European Union Public Licence",
        "Python Software Foundation License", "Server Software License 1.0", "terms of the end user license agreement", "SIL Open Font License", "Elastic License",
    ),
}
SPDX = {
    "MIT": ("MIT", "MIT-0"), "ISC": ("ISC",), "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD-4-Clause"), "Apache": ("Apache-2.0", "Apache-1.1"),
    "GPL": ("GPL-2.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0-only"), "LGPL": ("LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL-2.1-or-later"), "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL": ("MPL-2.0", "MPL-1.1"), "CC": ("CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CC-BY-NC-4.0"), "Unlicense": ("Unlicense",), "unknown": ("EPL-2.0", "Zlib", "BSL-1.0", "LicenseRef-Custom", "Artistic-2.0"),
}
FRAMES = (
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "{}", "License: {}",
    "The code is available under the {}.", "This software is released under the terms of the {}.", "Published under {}.", "See the {} for details.", "Copyright (c) 2020 the authors. {}.",
)
CALIBRATION_FRAMES = ("This package is made available under the {}.", "You may use it subject to the {}.", "Its source is covered by the {}; see LICENSE.", "Everything here is under {}.", "Licence: {}")
#: Licence-like sentences of no family.
OTHER = (
    "This software is subject to a separate license agreement between you and the vendor.", "Use of this product is governed by the terms of service and the end user license.",
    "The license fee is due within thirty days of the invoice.", "Permission to park is granted to residents only.", "The copyright of the photographs remains with the photographers.",
    "A license is required to operate this equipment.", "Third party components are covered by their own licenses.", "Licensees may install the program on one computer only.",
    "The author grants a non-transferable license for personal use.", "This license terminates automatically if you fail to comply with its terms.", "No warranty is given for the accuracy of these tables.",
)
#: Ordinary sentences, some with words that licences use.
ORDINARY = (
    "The meeting was held on Tuesday and the committee approved the budget.", "Rain is expected in the north with strong winds later in the day.", "She opened the general store at nine and sold bread to the public.",
    "Version two of the recipe uses less sugar and more butter.", "He was granted leave to visit his family in the country.", "The source of the river lies in the hills above the town.",
    "Visitors need a driving licence to hire a car at the airport.", "The fishing permit is valid for one season and is not free.", "The software crashed twice before the demonstration ended.",
    "Permission was refused and the march was called off.", "The warranty on the washing machine runs for two years.", "Public transport is free for children under six.",
    "The foundation published its yearly report in the spring.", "Students gave a creative performance in the commons.", "The general asked the public for patience.", "His driving licence expired in May.",
    "Their rights were reserved by an earlier treaty, the historian argues.", "The commons was full of sheep and the sheep were full of grass.", "An apache helicopter flew over the village.",
)
FAMILIES = ("none", *TEMPLATES, "unknown")


def usages(frames: tuple) -> list[tuple[str, str]]:
    """(text, family) of every frame with every name."""
    return [(f.format(n), k) for k, names in NAMES.items() for n in names for f in frames]


def spdx_lines(lead: str = "SPDX-License-Identifier: {}") -> list[tuple[str, str]]:
    return [(lead.format(n), k) for k, names in SPDX.items() for n in names]
