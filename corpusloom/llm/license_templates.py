"""Licence wording as template markup, with the label it stands for.

``<<beginOptional>> .. <<endOptional>>`` may be missing; ``<<var;name=..;original=..;match=..>>`` may
be replaced by words that match. The first three are the base phrases. MIT, BSD, ISC, 0BSD, zlib, Boost and Unlicense are whole
licences, the others are the notices by which documents name theirs.
"""

BASE = [
    ("mit", "MIT License"),
    ("apache", "Apache License"),
    ("gpl", "General Public License"),
]

_HOLDER = '<<var;name="holder";original="Copyright (c) YEAR HOLDER";match="(copyright|c) .+">>'
_RESERVED = "<<beginOptional>>All rights reserved.<<endOptional>>"
_VERSION = '<<var;name="version";original="4.0";match="[0-9]( [0-9])?">>'
_PROGRAM = '<<var;name="program";original="This program";match="(this|the) [^ ]+( [^ ]+){0,4}|[^ ]+">>'
_WHO = '<<var;name="who";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">>'
_LIABLE = '<<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">>'
_BSD_HEAD = ("<<beginOptional>>" + _HOLDER + _RESERVED + "<<endOptional>> Redistribution and use in source and binary forms, "
             "with or without modification, are permitted provided that the following conditions are met: "
             "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list "
             "of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must "
             "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
             "and/or other materials provided with the distribution. ")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY " + _WHO + ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
             "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
             + _LIABLE + " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
             "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
             "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
             "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
             "DAMAGE.")

TEMPLATES = [
    ("mit", "<<beginOptional>>" + _HOLDER + "<<endOptional>> Permission is hereby granted, free of charge, to any person obtaining "
     'a copy of this <<var;name="work";original="software and associated documentation files (the Software)";match=".+">>, to deal '
     "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
     "so, subject to the following conditions: The above copyright notice and this permission notice "
     "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of "
     'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
     "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
     '<<var;name="liable";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER '
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
     "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "<<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>><<beginOptional>>https"
     "<<endOptional>> www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "GNU General Public License<<beginOptional>>,<<endOptional>> version 2"),
    ("gpl-3.0", "GNU General Public License<<beginOptional>>,<<endOptional>> version 3"),
    ("gpl-2.0", _PROGRAM + " is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", _PROGRAM + " is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> CC BY-NC " + _VERSION),
    ("cc-by-sa", "Licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> CC BY-SA " + _VERSION),
    ("cc-by", "Licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> CC BY " + _VERSION),
    ("cc-by", "Creative Commons Attribution " + _VERSION + "<<beginOptional>>International<<endOptional>> License"),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", _BSD_HEAD + "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=\"org\";original=\"the copyright "
     "holder\";match=\".+\">> nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission. " + _BSD_TAIL),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO '
     "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
     '<<var;name="liable";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY '
     "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0bsd", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or "
     'without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";original="THE AUTHOR";match=".+">> DISCLAIMS ALL '
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
     '<<var;name="liable";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY '
     "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
     "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
     "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the "
     "original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
     "not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any "
     "source distribution."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit "
     "the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
     "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
     "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works "
     "of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
     'language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
     "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
     "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
     "all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
     "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
     "future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
     "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
