"""License scans with DataFrame functions only.

Two kinds of label:

* base labels: a phrase's words stand consecutively in the text;
* the method's labels, by an exact set-similarity join of text blocks with
  license notices. Blocks are windows of ``block_words`` words, each starting
  ``block_step`` after the last, so any run of up to ``block_words - block_step``
  words lies in one; longer templates are refused. A block has a template's label
  if it contains at least ``containment`` of the template's distinct words.

The join orders the templates' words by how many documents hold them, rarest
first. A block that reaches the threshold must hold one of a template's first
words (prefix filter), as many template words as the threshold asks (length
filter), and, from the places of the shared word in both orders, enough words
left to reach it (positional filter). What passes is compared in full.

Texts are read once: a table keeps each document's counts and the template words
it holds, and blocks, reduced to template words, of those documents that hold
enough words of some template. What is broadcast are the templates.

Results: null texts have no words and no labels. Rows with equal doc_id are
separate documents; equal rows get equal results. Base phrases compare words with
A-Z in lower case, templates words in lower case. score is the greatest
containment a block reaches, 1 where a base phrase stands, 0 without labels. An
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.llm.common import materialize

#: What words are made of, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license notices, as their words in lower case.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even"
        " the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the"
        " gnu general public license along with this program if not see https www gnu org licenses",
        "gpl-3.0-or-later",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this"
        " list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright"
        " holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular"
        " purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
        " including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of"
        " liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the"
        " possibility of such damage",
        "bsd-2-clause",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"
        " resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or"
        " performance of this software",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
        " https mozilla org mpl 2 0",
        "mpl-2.0",
    ),
    (
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or"
        " send a letter to creative commons po box 1866 mountain view ca 94042 usa",
        "cc-by-4.0",
    ),
)
#: Identifiers of the public license list, kinds of Creative Commons licenses, and further short headers.
IDENTIFIERS = (
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "mpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later",
    "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "unlicense", "cc0-1.0", "zlib", "bsl-1.0", "epl-2.0",
)
KINDS = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))
VERSIONS = (("2.0", "generic"), ("2.5", "generic"), ("3.0", "unported"), ("4.0", "international"))
HEADERS = (
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("use of this source code is governed by a bsd style license that can be found in the license file", "bsd-3-clause"),
    ("distributed under the boost software license version 1 0", "bsl-1.0"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license v2 0", "gpl-2.0"),
    ("licensed under the gnu general public license v3 0", "gpl-3.0"),
)


def _spoken(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text))


def short_forms() -> tuple[tuple[str, str], ...]:
    """One-line notices: what they say, as words, and their labels."""
    named = [(f"spdx license identifier {_spoken(i)}", i) for i in IDENTIFIERS]
    for kind, words in KINDS:
        for version, scope in VERSIONS:
            label = f"cc-{kind}-{version}"
            named += [(f"licensed under a creative commons {words} {_spoken(version)} {scope} license", label), (f"licensed under {_spoken(label)}", label), (f"spdx license identifier {_spoken(label)}", label)]
    return (*HEADERS, *named)


@dataclass(frozen=True)
class Notice:
    words: tuple[str, ...]  # the distinct ones
    needed: int
    label: str
    form: str | None  # the whole line of a short form


@dataclass(frozen=True)
class LicenseConfig:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    short: tuple[tuple[str, str], ...] = field(default_factory=short_forms)
    containment: float = 0.85
    block_words: int = 512
    block_step: int = 256

    def __post_init__(self):
        longest = max((len(text.split()) for text, _ in (*self.templates, *self.short)), default=0)
        if longest > self.block_words - self.block_step:
            raise ValueError(f"a template of {longest} words may lie in no block; raise block_words")

    def notices(self) -> list[Notice]:
        """Templates and short forms; of the latter all words are needed."""
        words = lambda text: tuple(sorted(set(text.split())))
        whole = [Notice(w, _needed(len(w), self.containment), label, None) for w, label in ((words(text), label) for text, label in self.templates)]
        return whole + [Notice(words(text), len(words(text)), label, text) for text, label in self.short]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _texts(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _needed(n: int, containment: float) -> int:
    return -(-int(round(n * containment * 1e6)) // 1_000_000)


@dataclass(frozen=True)
class OrderedTemplates:
    """Templates as ascending places of their words in the global order."""

    words: tuple[str, ...]  # by place, rarest first
    places: tuple[tuple[int, ...], ...]
    needed: tuple[int, ...]
    labels: tuple[str, ...]
    forms: tuple[str | None, ...]

    def prefix(self, t: int) -> tuple[int, ...]:
        return self.places[t][: len(self.places[t]) - self.needed[t] + 1]


def read_texts(docs: DataFrame, cfg: LicenseConfig) -> DataFrame:
    """doc_id, text_key, base columns, held (the template words of the text) and blocks (first_word, held), as a table."""
    notices = cfg.notices()
    vocabulary = sorted({w for n in notices for w in n.words})
    split = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.coalesce(words_of(F.col("text")), _texts([])).alias("words"))
    phrase_words = sorted({w for p, _ in cfg.phrases for w in p.split()})
    held = split.withColumn("held", F.array_intersect("words", _texts(vocabulary))).withColumn("said", F.array_intersect("words", _texts(phrase_words)))
    templates, forms = [n for n in notices if not n.form], [n for n in notices if n.form]
    enough = reduce(or_, [F.size(F.array_intersect("held", _texts(n.words))) >= n.needed for n in templates], F.lit(False))
    listed = F.array(*[F.struct(F.lit(n.form).alias("form"), _texts(n.words).alias("words")) for n in forms])
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    stands = lambda f: (F.size(F.array_except(f["words"], "held")) == 0) & F.contains(spaced(F.array_join("words", " ")), spaced(f["form"]))  # noqa: E731  # few texts get to the second test
    said = F.transform(F.filter(listed, stands), lambda f: f["form"]) if forms else _texts([])
    held = held.withColumn("forms", F.coalesce(said, _texts([])))
    enough = enough | (F.size("forms") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - cfg.block_words + cfg.block_step - 1, F.lit(0)), F.lit(cfg.block_step))
    blocks = F.transform(starts, lambda s: F.struct(s.alias("first_word"), F.array_intersect(F.slice(F.col("words"), s + 1, cfg.block_words), _texts(vocabulary)).alias("held")))
    text, phrases = F.coalesce("text", F.lit("")), [p for p, _ in cfg.phrases]
    may = reduce(or_, [F.size(F.array_intersect("said", _texts(sorted(set(p.split()))))) == len(set(p.split())) for p in phrases], F.lit(False))
    counts = [phrase_places(text, p) for p in phrases]
    zero = F.lit(0)
    return materialize(
        held.withColumn("may", may).select(
            "doc_id",
            "text_key",
            F.size("words").cast("long").alias("n_words"),
            F.when(F.col("may"), F.array(*counts)).otherwise(F.array(*[zero for _ in counts])).alias("n"),
            F.when(F.col("may"), _starts(text, phrases, last=False)).alias("first_word"),
            F.when(F.col("may"), _starts(text, phrases, last=True)).alias("last_word"),
            "held",
            "forms",
            F.when(enough, blocks).alias("blocks"),
        ),
        "license-words",
    )


def order_templates(read: DataFrame, cfg: LicenseConfig) -> OrderedTemplates:
    """Count, over all documents, how many hold each template word (there are as many rows as such words)."""
    notices = cfg.notices()
    vocabulary = sorted({w for n in notices for w in n.words})
    counts = {r["word"]: r["n"] for r in read.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    words = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(words)}
    return OrderedTemplates(tuple(words), tuple(tuple(sorted(place[w] for w in n.words)) for n in notices), tuple(n.needed for n in notices), tuple(n.label for n in notices), tuple(n.form for n in notices))


def template_matches(docs: DataFrame, cfg: LicenseConfig | None = None) -> DataFrame:
    """doc_id, text_key, first_word, template, label, containment of every block and template that reach the threshold."""
    cfg = cfg or LicenseConfig()
    return _matches(read_texts(docs.select("doc_id", "text"), cfg), cfg)


def _matches(read: DataFrame, cfg: LicenseConfig) -> DataFrame:
    t = order_templates(read, cfg)
    place = F.create_map(*[x for i, w in enumerate(t.words) for x in (F.lit(w), F.lit(i))])
    blocks = read.filter("blocks IS NOT NULL").select("doc_id", "text_key", "forms", F.explode("blocks").alias("b"))
    blocks = blocks.select("doc_id", "text_key", "forms", "b.first_word", F.array_sort(F.transform("b.held", lambda w: F.element_at(place, w))).alias("block"))
    blocks = blocks.filter(F.size("block") >= min(t.needed))
    heads = read.sparkSession.createDataFrame(
        [(p, i, at, list(t.places[i]), t.needed[i], t.labels[i], t.forms[i]) for i in range(len(t.labels)) for at, p in enumerate(t.prefix(i))],
        "place int, template int, at int, whole array<int>, needed int, label string, form string",
    )
    held = blocks.select("doc_id", "text_key", "forms", "first_word", "block", F.posexplode("block").alias("block_at", "place"))
    found = held.join(F.broadcast(heads), "place")  # as many rows as the templates have first words
    enough = F.least("at", "block_at") + 1 + F.least(F.size("whole") - F.col("at") - 1, F.size("block") - F.col("block_at") - 1)
    found = found.filter((F.size("block") >= F.col("needed")) & (enough >= F.col("needed")))
    common = F.size(F.array_intersect("block", "whole"))
    found = found.filter((common >= F.col("needed")) & (F.col("form").isNull() | F.array_contains("forms", F.col("form")))).withColumn("containment", common / F.size("whole"))
    return found.select("doc_id", "text_key", "first_word", "template", "label", "containment").distinct()


def phrase_places(text: Column, phrase: str) -> Column:
    """A pattern's zero-width matches: where the phrase's words stand consecutively, overlaps included."""
    return F.regexp_count(text, F.lit(_phrase_pattern(phrase)))


#: Words of texts that are not lower-cased yet, for patterns that ignore the case of A-Z.
_W, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _phrase_pattern(phrase: str) -> str:
    return rf"(?<!{_W})(?=(?i:{_GAP.join(phrase.split())})(?!{_W}))"


def _starts(text: Column, phrases: list[str], last: bool) -> Column:
    """The number of words before the first or last place of any phrase; null where there is none."""
    one = "|".join(_phrase_pattern(p) for p in phrases)
    head = F.regexp_extract(text, f"(?s)^(.*{'' if last else '?'})(?:{one})", 1)
    return F.when(F.regexp_like(text, F.lit(one)), F.regexp_count(head, F.lit(_W + "+")).cast("long"))


def scan_licenses(docs: DataFrame, cfg: LicenseConfig | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    cfg = cfg or LicenseConfig()
    base = read_texts(docs.select("doc_id", "text"), cfg)
    labels = F.array_compact(F.array(*[F.when(F.col("n")[i] > 0, F.lit(label)) for i, (_, label) in enumerate(cfg.phrases)]))
    by_text = _matches(base, cfg).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    base = base.withColumn("base", F.array_sort(F.array_distinct(labels))).withColumn("n_base", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).drop("held", "forms", "blocks")
    by_text = by_text.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "more", "containment")
    both = base.join(by_text, (F.col("text_key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
