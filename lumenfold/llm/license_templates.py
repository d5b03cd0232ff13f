"""Licence templates, in the markup that ``license_scan`` compiles.

Fixed values: public licence wording, plainly. ``<<beginOptional>>`` and ``<<endOptional>>`` enclose
words that may be missing; ``<<var;name=..;words=a-b>>`` stands for a to b words of any kind, and
``<<var;name=..;match=..>>`` for one word that the pattern matches whole.
"""

#: Phrase and label of the base scan.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_UNDER = "<<beginOptional>>this <<var;name=work;words=1-3>> is <<endOptional>>"

TEMPLATES = [
    ("gpl-notice", _UNDER + "licensed under the gnu general public license<<beginOptional>>, version <<var;name=version;match=[0-9]+>><<endOptional>>"),
    ("gpl-2", "gnu general public license<<beginOptional>> gpl<<endOptional>>, version 2"),
    ("gpl-3", "gnu general public license<<beginOptional>> gpl<<endOptional>>, version 3"),
    ("apache-notice", _UNDER + "licensed under the apache license<<beginOptional>>, version <<var;name=version;match=[0-9]+>> <<var;name=minor;match=[0-9]+>><<endOptional>>"),
    ("apache-2.0", "apache license, version 2.0"),
    ("mit-notice", _UNDER + "<<var;name=verb;match=released|licensed|distributed>> under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    ("cc-by-4.0", "cc by 4.0"),
    ("cc-by-sa", "cc by sa<<beginOptional>> <<var;name=version;match=[0-9]+>> 0<<endOptional>>"),
    ("cc-by-nc", "cc by nc<<beginOptional>> <<var;name=version;match=[0-9]+>> 0<<endOptional>>"),
    ("cc-by-nd", "cc by nd<<beginOptional>> <<var;name=version;match=[0-9]+>> 0<<endOptional>>"),
    ("cc-by-nc-sa", "cc by nc sa<<beginOptional>> <<var;name=version;match=[0-9]+>> 0<<endOptional>>"),
    ("all-rights-reserved", "all rights reserved"),
    (
        "mit-text",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall <<var;name=holder;words=1-12>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    (
        "isc-text",
        "permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-2-text",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-text",
        "<<beginOptional>>3. <<endOptional>>neither the name of <<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "apache-2.0-header",
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this <<var;name=file;words=1-3>> except in compliance with the license. you may obtain a copy of the license at",
    ),
    (
        "gpl-header",
        "is free software<<beginOptional>>; <<endOptional>><<beginOptional>>: <<endOptional>> you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version <<var;name=version;match=[0-9]+>> of the license, or (at your option) any later version.",
    ),
]
