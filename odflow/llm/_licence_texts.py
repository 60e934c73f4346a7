"""Known licence texts and notices.

Fixed values: public licence texts as published, and the usual one-line notices.
"""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_OPEN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_CLOSE = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_OPEN = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_CLOSE = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: (licence, kind, text): ``text`` is a whole licence, ``notice`` one line that grants or names one.
KNOWN: list[tuple[str, str, str]] = [
    ("MIT", "text", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "text", _MIT_GRANT),
    ("BSD-2-Clause", "text", _BSD_OPEN + _BSD_CLOSE),
    ("BSD-3-Clause", "text", _BSD_OPEN + _BSD_THIRD + _BSD_CLOSE),
    ("ISC", "text", _ISC_OPEN + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_CLOSE),
    ("0BSD", "text", _ISC_OPEN + "." + _ISC_CLOSE),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "notice", "All rights reserved."),
]

_TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License",
                     "New BSD License", "Revised BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
}
_BODIES = {name: text for name, kind, text in KNOWN if kind == "text"}
_ISC_AND = _BODIES["ISC"].replace("and/or distribute", "and distribute")
#: The texts above under their usual title lines, and without numbers before the conditions.
TITLED: list[tuple[str, str, str]] = [
    (name, "text", title + body)
    for name, titles in _TITLES.items() for title in ["", *[t + "\n\n" for t in titles]]
    for body in dict.fromkeys([_BODIES[name], _BODIES[name].replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "),
                               *([_ISC_AND] if name == "ISC" else [])])
]

#: (licence, digest) of whole licences as published, made by ``canonical`` without holders' lines:
#: with and without the appendix behind the terms, http and https links.
FULL: list[tuple[str, str]] = [
    ("Apache-2.0", "129294488cadbe2acee6d28d177d42a3acc4e0cfb69893738a3ca4965b35cdf9"),
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", "4f14b6cbdd362d5a6d1023eaee7538d57a6c9271c5e1de4bdc60e02a182c0730"),
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("CC-BY-SA-4.0", "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "0c64ee746791150d3c6210d29a2984d92afca30fa433f834ca884a3002b96384"),
    ("GPL-2.0", "0f235ec4132d80f44b01ed351abb7f9b1c0b86cd4cc4d8532e632188d1bdfb2b"),
    ("GPL-2.0", "167af632af808c0ecc0422c201f8e3ee3f23858845a64ea6bdbae2175bee3101"),
    ("GPL-2.0", "46ec682e8becf1a940f25e4a762e223a9bf07dbe74bde1b6305471593dc922a0"),
    ("GPL-2.0", "6186c2b9e1fbbfe994a454357b050eab51d49760436171460ff3d09dc6877fd1"),
    ("GPL-2.0", "9f09905c095ca67f0f87b18b9d330d3b43cd6a75a43a0cb1a39cdbc257601443"),
    ("GPL-2.0", "9f871ce679a9dd4c702298774a45f34fe5dda57aaa9492c1214c525d59a72b16"),
    ("GPL-2.0", "a692f1cb3097cff45a40a996ead5dd80162238fb68187fdcd1a02eb56656e007"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "ebd4f0d228fbcd41efd19a83a933502ccc7f758b9c0acdf5b6400819af646b75"),
    ("GPL-3.0", "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("GPL-3.0", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", "719567f94c59314608007f0c51247c578702bae1919b3a2410889832649a72d8"),
    ("GPL-3.0", "f57dc110ec70381765c7a95b7c56af79956ff5b57624f88ae05cc8486b46813d"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
