"""License scans: templates with optional and replaceable regions, compiled into token automata.

In a template ``[...]`` is optional, ``{n}`` stands for up to n words of any kind, and all other words are
mandatory and must match exactly. A template is accepted at a place of a text if its automaton reaches its end
from there. Apart from the templates, four plain phrases are counted.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A null or empty text has no
words and score 0. Repeated rows give repeated results; other columns are ignored.

``score`` is 1 where a template is accepted, else the larger of 0.5 (a phrase occurs) and 0.9 times the share
of mandatory words that the best automaton got through.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from wattloom.llm.common import columns_of, map_batches, words_of

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double")
#: The plain phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license texts in the words that the matcher sees
TEMPLATES = {
    "gpl-2.0": "gnu general public license [as published by the free software foundation] [either] version 2",
    "gpl-3.0": "gnu general public license [as published by the free software foundation] [either] version 3",
    "apache-2.0": "apache license [version] 2 0",
    "cc-by-4.0": "cc by 4 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-nd-4.0": "cc by nd 4 0",
    "cc-by-nc-sa-4.0": "cc by nc sa 4 0", "cc-by-nc-nd-4.0": "cc by nc nd 4 0",
    "gpl-notice": "[this work is] licensed under the [terms of the] gnu general public license",
    "apache-notice": "licensed under the apache license [version 2 0] [the license]",
    "mit-notice": "[this {3} is] [licensed] released under the [terms of the] mit license",
    "cc-notice": "licensed under [a] [the] [creative commons] cc by",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at [http] [https] www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
        as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
    "gpl-header": """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation [either] version {1} of the license [or at your option any
        later version] this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
        details""",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice [including the next paragraph] shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
        of or in connection with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [1] redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [1] redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution [3] neither the name of {12} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
}
ANY = None


class Automaton:
    """States 0..n; ``steps[s]`` is (word or ANY, next state), ``free[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int] | None] = []
        self.free: list[list[int]] = []
        self.done: list[int] = []                       # mandatory words before each state
        opened, count, depth = [], 0, 0

        def state(step):
            self.steps.append(step)
            self.free.append([])
            self.done.append(count)
            return len(self.steps) - 1
        for t in template.replace("[", " [ ").replace("]", " ] ").split():
            if t == "[":
                opened.append(state(None))
                self.free[-1].append(len(self.steps))
                depth += 1
            elif t == "]":
                self.free[opened.pop()].append(len(self.steps))
                depth -= 1
            elif t[0] == "{":
                limit = int(t[1:-1])
                end = len(self.steps) + limit
                for _ in range(limit):
                    at = state((ANY, len(self.steps) + 1))
                    self.free[at].append(end)
            else:
                state((t.encode(), len(self.steps) + 1))
                count += not depth
        state(None)
        self.end, self.total = len(self.steps) - 1, count
        self.first = {self.steps[s][0] for s in self.closure({0}) if self.steps[s]}

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> float:
        """Share of the mandatory words matched from ``at`` on; 1 if the end is reached."""
        states, best = self.closure({0}), 0
        for i in range(at, len(words) + 1):
            if self.end in states:
                return 1.0
            best = max(best, max(self.done[s] for s in states))
            if i == len(words):
                break
            moved = {self.steps[s][1] for s in states if self.steps[s] and self.steps[s][0] in (words[i], ANY)}
            if not moved:
                break
            states = self.closure(moved)
        return best / self.total if self.total else 0.0


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in TEMPLATES.items()}


def _places(words: list[bytes], word: bytes):
    at = -1
    try:
        while True:
            at = words.index(word, at + 1)
            yield at
    except ValueError:
        return


def scan_text(text: str | None) -> tuple:
    words = words_of(text)
    plain = b" ".join(words)
    places, base = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.encode().split()
        found = [p for p in _places(words, want[0]) if words[p:p + len(want)] == want] if phrase.encode() in plain else []
        places += found
        if found:
            base.add(label)
    labels, best = set(base), 0.0
    present = set(words)
    for label, automaton in automata().items():
        share = 0.0
        for word in automaton.first & present:
            for p in _places(words, word):
                share = max(share, automaton.match(words, p))
                if share == 1.0:
                    break
        if share == 1.0:
            labels.add(label)
        best = max(best, share)
    score = 1.0 if best == 1.0 else max(0.5 if base else 0.0, 0.9 * best)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score)


def scan(documents: DataFrame) -> DataFrame:
    """One row per document; needs no shuffle."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def rows(cols):
        found = [scan_text(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}
    return map_batches(columns_of(documents, "doc_id", "text"), SCHEMA, rows)
