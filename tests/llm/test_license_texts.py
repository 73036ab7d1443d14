"""The unedited standard texts of the licences that the rules name."""

import pytest

from kassa.llm import licenses as lc

ASIS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
MIT = """MIT License

Copyright (c) [year] [fullname]

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

""" + ASIS + """IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_HEAD = """Copyright (c) 2014, Example Labs Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_ADVERT = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
     This product includes software developed by Example Labs Inc.

4. Neither the name of Example Labs Inc. nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL ISC BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
ZLIB = """zlib License

Copyright (c) 2020 Jane Example

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
APACHE = """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
ASF = """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

""" + ASIS + """IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
"""
BOOST_NOTICE = """//          Copyright Joe Coder 2004 - 2006.
// Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at
//          https://www.boost.org/LICENSE_1_0.txt)
"""
TITLE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"


def gnu(name, version, mark, thing="program", end="either version {} of the License, or\n    (at your option) any later version.", tail="If not, see <https://www.gnu.org/licenses/>."):
    return f"""    This {thing} is free software{mark} you can redistribute it and/or modify
    it under the terms of the {name} as published by
    the Free Software Foundation{',' if mark == ':' else ';'} {end.format(version)}

    This {thing} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    {name} for more details.

    You should have received a copy of the {name}
    along with this {thing}{'.' if mark == ':' else ';'}  {tail}
"""


FRANKLIN = "if not, write to the Free Software Foundation, Inc.,\n    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
TEXTS = [
    (MIT, "MIT"), (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"), (BSD_HEAD + BSD_ENDORSE + BSD_TAIL, "BSD-3-Clause"),
    (BSD_HEAD + BSD_ADVERT + BSD_TAIL, "BSD-4-Clause"),
    (BSD_HEAD.replace("1. ", "(a) ").replace("2. ", "b) ") + BSD_TAIL, "BSD-2-Clause"),
    ((BSD_HEAD + BSD_ENDORSE + BSD_TAIL).replace("\n", " "), "BSD-3-Clause"),
    ((BSD_HEAD + BSD_ENDORSE + BSD_TAIL).replace("the copyright holder nor", "the Example Labs Inc. nor")
     .replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE LABS INC. ''"), "BSD-3-Clause"),
    (ISC, "ISC"), (ZLIB, "Zlib"), (APACHE, "Apache-2.0"), (ASF, "Apache-2.0"), (TITLE, "Apache-2.0"), (MPL, "MPL-2.0"),
    (UNLICENSE, "Unlicense"), (BOOST, "BSL-1.0"), (BOOST_NOTICE, "BSL-1.0"),
    (gnu("GNU General Public License", "3", ":"), "GPL-3.0-or-later"),
    (gnu("GNU General Public License", "2", ";", tail=FRANKLIN), "GPL-2.0-or-later"),
    (gnu("GNU General Public License", "2", ";", end="version {} of the License.", tail=FRANKLIN), "GPL-2.0-only"),
    (gnu("GNU Lesser General Public License", "2.1", ";", "library", tail=FRANKLIN), "LGPL-2.1-or-later"),
    (gnu("GNU Lesser General Public License", "3", ":"), "LGPL-3.0-or-later"),
    (gnu("GNU Affero General Public License", "3", ":"), "AGPL-3.0-or-later"),
]


@pytest.mark.parametrize("at", range(len(TEXTS)))
def test_standard_text(at):
    text, want = TEXTS[at]
    s = lc.Scanner()
    for t in (text, "".join(f" * {line}\n" for line in text.splitlines()), "Some words before.\n\n" + text + "\nand after it"):
        ids = s.identifiers(t)
        assert s.licences(ids) == ([want], []), ids


def test_every_licence_of_the_rules_has_a_text():
    assert {name for name, _ in lc.RULES} <= {want for _, want in TEXTS}


def test_free_words_are_bounded():
    s = lc.Scanner({"a": ("made by * for all",)}, (("A", ("a",)),))
    assert s.identifiers("Made by Foo Inc. for all. And more") == ["a", "?"]
    assert s.identifiers("Made by " + "foo " * (lc.MOST_FREE + 1) + "for all.") == ["?"]
    assert s.identifiers("Made by for all.") == ["?"]
