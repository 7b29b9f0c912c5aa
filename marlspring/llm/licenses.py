"""Operator 10: licence scans by template-markup matching.

A template is a run of words with marked regions: ``<<optional: ...>>`` may be absent and
``<<var: n>>`` stands for up to n words of any kind. Each template compiles into an automaton over
tokens (states, transitions on a word or on any word, and empty moves, here resolved ahead); a text is
accepted where some path consumes every word of the mandatory wording exactly. All automata start from
a known first word, and a task only runs them on texts that hold all mandatory words. There is no shuffle and no join.

There are templates of whole licence texts as published and of notices, sentences that name a licence.
A whole text may stand anywhere in a document, with a title or other words around it.

Base labels are phrases whose words stand consecutively; a template adds its own label beside them.

Defined results: null and empty texts have no words, no places, empty labels and score 0; overlapping
places all count; repeated rows give repeated rows; an empty table gives no rows; extra columns are
ignored. The score is 1.0 where a whole licence text is accepted, 0.9 where a notice is that no denial
("not released under the MIT license") stands before, 0.5 where only a base phrase stands, else 0.0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from marlspring.llm.common import slices, text_of

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence texts as published, as words; holders' names are replaceable, what variants leave out is optional.
TEXTS = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice <<optional: including the next paragraph>> shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or
        implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall <<var: 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and <<optional: or>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        <<var: 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
        event shall <<var: 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from
        loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
        the use or performance of this software"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<optional: 1>> redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer <<optional: 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by
        <<var: 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed in no event shall <<var: 12>> be liable for any direct indirect incidental special
        exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
        or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence
        or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<optional: 1>> redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer <<optional: 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution <<optional: 3>> neither the name of
        <<var: 12>> nor the names of <<var: 3>> contributors may be used to endorse or promote products derived from this software without
        specific prior written permission this software is provided by <<var: 12>> as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var: 12>>
        be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether
        in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised
        of the possibility of such damage"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions <<optional: 1>> the origin of this software
        must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
        acknowledgment in the product documentation would be appreciated but is not required <<optional: 2>> altered source versions must be
        plainly marked as such and must not be misrepresented as being the original software <<optional: 3>> this notice may not be removed or
        altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim
        damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software"""),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use <<var: 3>> except in compliance with the license you may
        obtain a copy of the license at <<optional: http>> <<optional: https>> www apache org licenses license 2 0 unless required by applicable
        law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl-2.0", """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 2 of the license or at your option any later version <<var: 8>> is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details"""),
    ("gpl-3.0", """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 3 of the license or at your option any later version <<var: 8>> is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details"""),
]

#: Sentences that name a licence, as templates.
NOTICES = [
    ("gpl-2.0", "licensed under the <<optional: terms of the>> gnu general public license <<optional: as published by the free software foundation>> <<optional: either>> version 2"),
    ("gpl-3.0", "licensed under the <<optional: terms of the>> gnu general public license <<optional: as published by the free software foundation>> <<optional: either>> version 3"),
    ("lgpl", "licensed under the <<optional: terms of the>> gnu lesser general public license"),
    ("apache-2.0", "licensed under the <<optional: terms of the>> apache license version 2 <<optional: 0>>"),
    ("apache-2.0", "apache license version 2 0 <<var: 6>> terms and conditions for use reproduction and distribution"),
    ("mit", "<<optional: released>> under the <<optional: terms of the>> mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under <<optional: a>> <<optional: creative commons>> <<optional: attribution>> cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under <<optional: a>> <<optional: creative commons>> <<optional: attribution>> cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under <<optional: a>> <<optional: creative commons>> <<optional: attribution>> cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal <<optional: public domain dedication>>"),
    ("all-rights-reserved", "copyright <<var: 8>> all rights reserved"),
]
#: Words that, within ``AHEAD`` words before a notice, deny it.
DENIALS, AHEAD = frozenset(b"not never isn don nor without".split()), 4
#: Scores: a whole licence text, a notice, a base phrase only.
SCORES = {"text": 1.0, "notice": 0.9, "base": 0.5}
#: Words are runs outside these bytes once A-Z are lower case (all other ASCII bytes part them).
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Automaton:
    """Tokens of one template; ``step[i]`` lists (word or None for any, next state), after empty moves."""

    def __init__(self, label: str, markup: str, kind: str = "notice"):
        self.label, self.kind = label, kind
        moves: list[list[tuple[bytes | None, int]]] = [[]]
        free: list[set[int]] = [set()]
        mandatory = []

        def state() -> int:
            moves.append([])
            free.append(set())
            return len(moves) - 1

        at = 0
        for kind, inner, word in re.findall(r"<<(optional|var): ([^>]*)>>|(\S+)", markup):
            if kind == "optional":
                begin = at
                for w in inner.split():
                    to = state()
                    moves[at].append((w.encode(), to))
                    at = to
                free[begin].add(at)
            elif kind == "var":
                first = at
                for _ in range(int(inner)):
                    to = state()
                    moves[at].append((None, to))
                    at = to
                for s in range(first, at):
                    free[s].add(at)
            else:
                to = state()
                moves[at].append((word.encode(), to))
                mandatory.append(word.encode())
                at = to
        self.end = at
        closed = []
        for s in range(len(moves)):
            seen, todo = {s}, [s]
            while todo:
                for t in free[todo.pop()] - seen:
                    seen.add(t)
                    todo.append(t)
            closed.append(seen)
        self.closed = closed
        self.moves = moves
        self.first = {w for s in closed[0] for w, _ in moves[s]}
        self.mandatory = sorted(set(mandatory), key=len, reverse=True)

    def accepts(self, words: list[bytes], start: int) -> bool:
        states = self.closed[0]
        for word in words[start:]:
            states = {c for s in states for w, to in self.moves[s] if w is None or w == word for c in self.closed[to]}
            if self.end in states:
                return True
            if not states:
                return False
        return False

    def found_in(self, words: list[bytes]) -> bool:
        """Whether some place of the words starts an accepted run that, for a notice, no denial stands before."""
        for i, w in enumerate(words):
            if w in self.first and self.accepts(words, i) and not (self.kind == "notice" and DENIALS.intersection(words[max(0, i - AHEAD) : i])):
                return True
        return False


def scan(raw: bytes, base: list[tuple[list[bytes], str]], automata: list[Automaton]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    folded = raw.translate(_FOLD)
    words = folded.split()
    places, found = [], set()
    for phrase, label in base:
        if all(w in folded for w in phrase):
            k = len(phrase)
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + k] == phrase:
                    places.append(at)
                    found.add(label)
    accepted, score = set(), SCORES["base"] if places else 0.0
    for a in automata:
        if all(w in folded for w in a.mandatory) and a.found_in(words):
            accepted.add(a.label)
            score = max(score, SCORES[a.kind])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | accepted)), score


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def license_scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id and the scan of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [*(Automaton(*t, "text") for t in texts), *(Automaton(*t, "notice") for t in notices)]
        phrases = [([w.encode() for w in p.split()], label) for p, label in base.items()]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan((t or "").encode(), phrases, automata) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FIELDS))], ["doc_id", *(n for n, _ in FIELDS)])

    return text_of(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
