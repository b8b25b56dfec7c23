"""License scans: licence templates with optional and replaceable regions, compiled to token automata.

Markup: <<opt>> ... <</opt>> may be missing, <<var:a-b>> stands for a to b words of any kind, (x|y) in one word's place
takes either word. All other words are mandatory and must match exactly after case and signs are folded away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from susceptra.llm.text import ascii_lower, text_of
from susceptra.storage import bounded_batches, free_name

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public licence wordings and the usual notices. A full text scores 1, a notice NOTICE_SCORE.
TEMPLATES = (
    ("mit-text", 1.0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<opt>>\"<</opt>>Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", 1.0, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var:1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-text", 1.0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<opt>>1.<</opt>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<opt>>2.<</opt>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<opt>><<opt>>3.<</opt>> Neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<</opt>> THIS SOFTWARE IS PROVIDED BY <<var:1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib-text", 1.0, "This software is provided <<var:1-3>> without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<</opt>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2.<</opt>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3.<</opt>> This notice may not be removed or altered from any source distribution."),
    ("apache-header", 1.0, "Licensed under the Apache License, Version 2.0 (the <<opt>>\"<</opt>>License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var:4-12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-notice", 0.8, "licensed under the Apache License <<opt>>Version<</opt>> <<opt>>2<</opt>> <<opt>>0<</opt>>"),
    ("mit-notice", 0.8, "(released|licensed|distributed|available|published) under <<opt>>the<</opt>> <<opt>>terms of the<</opt>> MIT License"),
    ("gpl-notice", 0.8, "(licensed|distributed|released|modify) <<opt>>it<</opt>> under <<opt>>the<</opt>> <<opt>>terms of the<</opt>> GNU <<opt>>(Lesser|Affero|Library)<</opt>> General Public License <<opt>><<opt>>as published by the Free Software Foundation either<</opt>> version <<var:1-1>><</opt>>"),
    ("cc-notice", 0.8, "licensed under <<opt>>a<</opt>> (CC|Creative) <<opt>>Commons<</opt>> (BY|Attribution) <<opt>>(NC|NonCommercial)<</opt>> <<opt>>(SA|ND|ShareAlike)<</opt>> <<var:1-2>>"),
)
BASE_SCORE = 0.5
_MARK = re.compile(r"<<(/?opt|var:\d+-\d+)>>|\(([^()|\s]+(?:\|[^()|\s]+)+)\)|(" + WORD + ")")


@dataclass(frozen=True)
class Automaton:
    """States with word edges (word -> next states), any-word edges and the accepting states; skips are closed over."""

    label: str
    score: float
    words: tuple[dict[str, frozenset[int]], ...]
    any_word: tuple[frozenset[int], ...]
    start: frozenset[int]
    final: frozenset[int]

    def match(self, tokens: list[str], at: int) -> int:
        """End of the longest match that starts at a token, or -1. Once the rest is optional, it is accepted at once and read on."""
        now, best = self.start, -1
        while now:
            if now & self.final:
                best = at
            if at >= len(tokens):
                break
            step: set[int] = set()
            for s in now:
                step |= self.words[s].get(tokens[at], frozenset())
                step |= self.any_word[s]
            now, at = step, at + 1
        return best

    def first(self) -> set[str]:
        return {w for s in self.start for w in self.words[s]}


def compile_template(label: str, score: float, markup: str) -> Automaton:
    """Markup to automaton. Raises on unbalanced regions and on templates that start with a gap or may be empty."""
    edges: list[list[tuple[str | None, int]]] = [[]]
    skips: list[set[int]] = [set()]

    def state() -> int:
        edges.append([])
        skips.append(set())
        return len(edges) - 1

    at, open_regions = 0, []
    for mark, choice, word in _MARK.findall(markup.lower()):
        if mark == "opt":
            open_regions.append(at)
        elif mark == "/opt":
            if not open_regions:
                raise ValueError(f"{label}: a region ends that never began")
            end = state()
            skips[at].add(end)
            skips[open_regions.pop()].add(end)
            at = end
        elif mark:
            low, high = map(int, mark[4:].split("-"))
            ends = []
            for i in range(high):
                if i >= low:
                    ends.append(at)
                to = state()
                edges[at].append((None, to))
                at = to
            for s in ends:
                skips[s].add(at)
        else:
            to = state()
            for w in (choice.split("|") if choice else [word]):
                edges[at].append((w.lower(), to))
            at = to
    if open_regions:
        raise ValueError(f"{label}: a region is never closed")

    def closed(s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in skips[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    words = tuple({w: frozenset().union(*(closed(t) for x, t in out if x == w)) for w in {x for x, _ in out if x is not None}} for out in edges)
    gaps = tuple(frozenset().union(*(closed(t) for x, t in out if x is None)) for out in edges)
    made = Automaton(label, score, words, gaps, closed(0), frozenset({at}))
    if made.start & made.final or any(gaps[s] for s in made.start):
        raise ValueError(f"{label}: a template must start with a mandatory word")
    return made


def mandatory_word(markup: str) -> str:
    """The longest word that every text of the template holds: outside of optional regions and no choice."""
    depth, best = 0, ""
    for mark, _choice, word in _MARK.findall(markup):
        depth += (mark == "opt") - (mark == "/opt")
        if word and not depth and (len(word), word.lower()) > (len(best), best):
            best = word.lower()
    return best


def hint(templates) -> str:
    """A pattern that every text matches which holds a phrase or a template; the others need no scan."""
    words = {max(p.split(), key=lambda w: (len(w), w)) for p, _ in PHRASES} | {mandatory_word(t[2]) for t in templates}
    return "|".join(sorted(re.escape(w) for w in words)) if all(words) else ""


def scan(text: str | None, automata: list[Automaton]) -> dict:
    """Words, base places and template matches of one text that is already lower-cased."""
    tokens = re.findall(WORD, text or "")
    where: dict[str, list[int]] = {}
    starts = {w for a in automata for w in a.first()} | {p.split()[0] for p, _ in PHRASES}
    for i, t in enumerate(tokens):
        if t in starts:
            where.setdefault(t, []).append(i)
    places, base = [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        hits = [i for i in where.get(parts[0], ()) if tokens[i : i + len(parts)] == parts]
        places += hits
        base |= {label} if hits else set()
    spans = [(i, end, a.label, a.score) for a in automata for w in sorted(a.first()) for i in where.get(w, ()) if (end := a.match(tokens, i)) > 0]
    return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": sorted(base), "spans": sorted(spans), "labels": sorted(base | {s[2] for s in spans}), "score": max([BASE_SCORE if places else 0.0, *(s[3] for s in spans)])}


def license_scan(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """docs without text, plus n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    spans holds (start, end, label) of every template match, in words. Null text is empty: no words, no labels, score 0.
    Only texts that hold some template's or phrase's longest mandatory word leave the JVM; all texts are counted whole. Repeated rows and other
    columns are kept, whatever their names; columns named like results are replaced. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    automata = [compile_template(*t) for t in templates]
    kind = "n_base long, first_word long, last_word long, base_labels string, spans array<struct<start:long,end:long,label:string>>, labels string, score double"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.DataFrame:
        none = scan("", automata)
        rows = [scan(t, automata) if t else none for t in texts]
        return pd.DataFrame({
            "n_base": [r["n_base"] for r in rows],
            "first_word": pd.array([r["first_word"] for r in rows], "Int64"),
            "last_word": pd.array([r["last_word"] for r in rows], "Int64"),
            "base_labels": [",".join(r["base_labels"]) for r in rows],
            "spans": [[{"start": a, "end": b, "label": n} for a, b, n, _ in r["spans"]] for r in rows],
            "labels": [",".join(r["labels"]) for r in rows],
            "score": [r["score"] for r in rows],
        })

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score"]
    keep = [c for c in docs.columns if c not in [*names, text]]
    low: Column = ascii_lower(text_of(text))
    whole, hinted, result = (free_name(docs, x) for x in ("__low", "__hint", "__found"))
    ready = docs.select(*[F.col(f"`{c}`") for c in keep], low.alias(whole)).withColumn("n_words", F.regexp_count(F.col(whole), F.lit(WORD)).cast("long"))
    ready = ready.withColumn(hinted, F.when(F.col(whole).rlike(hint(templates)), F.col(whole)))
    return ready.withColumn(result, found(hinted)).select(*[F.col(f"`{c}`") for c in keep], "n_words", *[F.col(result)[n].alias(n) for n in names[1:]])
