"""License wordings in template markup.

`[[ ... ]]` is an optional region (may nest), `{{ n }}` a replaceable region of 0 to n words;
everything else is mandatory wording, matched word by word without case and punctuation.
Optional regions before the first mandatory word change nothing in what is accepted and are
passed over; whole licenses are given where they are short, else their notices.
Fixed values: the wordings are the licenses' own.
"""

TEMPLATES: dict[str, tuple[str, float, str]] = {
    # name: (label, score, wording)
    "mit-text": ("mit", 1.0, """
        [[ The MIT License [[ (MIT) ]] ]] [[ Copyright {{ 40 }} ]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the {{ 3 }} Software {{ 3 }}), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[ (including the next paragraph) ]] shall be included in all copies or substantial
        portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        {{ 20 }} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "isc-text": ("isc", 1.0, """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {{ 10 }} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    "bsd-text": ("bsd", 1.0, """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[ 1. ]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. [[ [[ 3. ]] Neither the name of {{ 20 }} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. ]]
        THIS SOFTWARE IS PROVIDED BY {{ 20 }} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""),
    "apache-notice": ("apache-2.0", 1.0, """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at [[ http https ]] {{ 8 }} LICENSE 2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS"""),
    "gpl-notice": ("gpl", 1.0, """
        This program is free software [[ ; ]] you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation [[ ; ]] either version {{ 3 }} of the License [[ or at your option any later version ]]"""),
    "mit-reference": ("mit", 0.9, "Released under the [[ terms of the ]] MIT License"),
    "mit-licensed": ("mit", 0.9, "Licensed under the [[ terms of the ]] MIT License"),
    "apache-reference": ("apache-2.0", 0.9, "Licensed under the [[ terms of the ]] Apache License [[ Version ]] 2.0"),
    "gpl3-reference": ("gpl-3.0", 0.9, "licensed under the [[ terms of the ]] GNU General Public License [[ version ]] 3 [[ 0 ]]"),
    "gpl2-reference": ("gpl-2.0", 0.9, "licensed under the [[ terms of the ]] GNU General Public License [[ version ]] 2 [[ 0 ]]"),
    "cc-by-nc": ("cc-by-nc-4.0", 0.9, "Licensed under [[ a ]] [[ the ]] CC BY NC 4.0"),
    "cc-by": ("cc-by-4.0", 0.9, "Licensed under [[ a ]] [[ the ]] CC BY 4.0"),
    "bsd-2-clause-text": ("bsd-2-clause", 1.0, """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[ 1. ]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution.
        THIS SOFTWARE IS PROVIDED BY {{ 20 }} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{ 20 }} BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "bsd-3-clause-text": ("bsd-3-clause", 1.0, """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[ 1. ]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. [[ 3. ]] Neither the name of {{ 20 }} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY {{ 20 }} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{ 20 }} BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "zlib-text": ("zlib", 1.0, """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[ 1. ]] The origin of
        this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. [[ 2. ]] Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. [[ 3. ]] This notice may not be
        removed or altered from any source distribution."""),
    "boost-text": ("bsl-1.0", 1.0, """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the {{ 3 }} Software {{ 3 }}) to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so,
        all subject to the following:"""),
    "unlicense-text": ("unlicense", 1.0, """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    "mpl-notice": ("mpl-2.0", 1.0, """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at {{ 8 }} mozilla {{ 2 }} MPL 2.0"""),
    "lgpl-notice": ("lgpl", 1.0, """
        This [[ program ]] [[ library ]] is free software [[ ; ]] you can redistribute it and/or modify it under the terms of the GNU [[ Lesser ]]
        [[ Library ]] General Public License as published by the Free Software Foundation [[ ; ]] either version {{ 3 }} of the License, or at
        your option any later version. This [[ program ]] [[ library ]] is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[ Lesser ]] [[ Library ]]
        General Public License for more details. {{ 40 }} GNU Lesser General Public License"""),
    "agpl-notice": ("agpl", 1.0, """
        This program is free software [[ ; ]] you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation [[ ; ]] either version {{ 3 }} of the License [[ or at your option any later version ]]"""),
}
