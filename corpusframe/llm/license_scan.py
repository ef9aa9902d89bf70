"""Licence scans by a positional rare-token index over licence templates."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_texts, table

#: Phrases whose every place counts, with their labels (fixed values).
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Templates: label, text, key phrases that a match must hold. Words of public licence notices and of
#: the heads of licence texts (fixed values). A family's label comes from any version's notice, a
#: version's label only where its own key phrase stands.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license",)),
    ("bsd", "licensed under the bsd 3 clause license", ("the bsd",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal public domain dedication", ("waived all copyright",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("gnu general public license version 2 june 1991",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3 29 june 2007",)),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ("gnu affero general public license version 3",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0 january 2004",)),
    ("mpl-2", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ("mozilla public license version 2 0",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license",)),
    ("epl-2", "licensed under the eclipse public license version 2 0", ("eclipse public license version 2 0",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ("any person or organization obtaining a copy",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    ("artistic-2", "you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
)
#: Words of a file that a template is looked up by, those of the highest IDF; how many of them must
#: agree on a place; and the share of a template that a match must show.
RARE_WORDS, AGREE, COVERAGE = 6, 2, 0.6

#: ASCII letters become lower case; all bytes that are not of a word become spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def holds(words: list[bytes], key: bytes) -> bool:
    return b" " + key + b" " in b" " + b" ".join(words) + b" "


class RareTokenIndex:
    """A positional index of licence templates: for every word its places in each template.

    Only templates all of whose mandatory words are in a file are looked up. Of a template's words
    that the file holds, those of the highest IDF (over the templates) are taken; a word at place p
    of the file and i of the template says that the template starts at p - i. The starts that
    different words say are intersected: as far apart as words may have been put in or left out,
    AGREE of them must meet. From each start of such a place the mandatory phrases are verified, and the
    share of the template's words that stand in their order; the largest share counts. Phrases are templates of which every word
    must stand, so the starts of all their words are intersected exactly."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, rare_words: int = RARE_WORDS, agree: int = AGREE, coverage: float = COVERAGE):
        entries = [(label, p, (p,), 1.0, True) for p, label in phrases]
        entries += [(label, t, keys, coverage, False) for label, t, keys in templates]
        self.words = [words_of(t) for _, t, _, _, _ in entries]
        self.entries = [(label, need, base) for label, _, _, need, base in entries]
        self.rare_words, self.agree = rare_words, agree
        df = Counter(w for ws in self.words for w in set(ws))
        self.idf = {w: math.log(1 + len(entries) / n) for w, n in df.items()}
        self.keys = [[b" ".join(words_of(k)) for k in keys] for _, _, keys, _, _ in entries]
        self.must = [frozenset(w for k in keys for w in k.split()) for keys in self.keys]
        self.places: list[dict[bytes, list[int]]] = []
        self.order: list[list[bytes]] = []
        for ws in self.words:
            at: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(ws):
                at[w].append(i)
            self.places.append(dict(at))
            self.order.append(sorted(at, key=lambda w: (-self.idf[w], -len(w), w)))

    def slack(self, t: int) -> int:
        """How far words put in or left out may move a template's others."""
        return max(3, len(self.words[t]) // 4)

    def meeting(self, t: int, at: dict[bytes, list[int]], rare: list[bytes]) -> list[range]:
        """Places where enough of the rare words agree, each as the starts that template t may have there."""
        said = sorted((p - i, w) for w in rare for p in at[w] for i in self.places[t][w])
        enough, reach, out = min(self.agree, len(rare)), self.slack(t), []
        lo = hi = 0
        seen: Counter = Counter()
        while lo < len(said):
            while hi < len(said) and said[hi][0] <= said[lo][0] + reach:
                seen[said[hi][1]] += 1
                hi += 1
            if len(seen) >= enough:
                out.append(range(said[lo][0] - reach, said[hi - 1][0] + reach + 1))
                lo, seen = hi, Counter()
                continue
            w = said[lo][1]
            seen[w] -= 1
            if not seen[w]:
                del seen[w]
            lo += 1
        return out

    def verified(self, t: int, ws: list[bytes], start: int) -> tuple[int, float] | None:
        """Where template t begins near start and the share of it that stands there in order, if its
        mandatory phrases stand there as well."""
        mine, lo = self.words[t], max(0, start - self.slack(t))
        there = ws[lo : start + len(mine) + self.slack(t)]
        if not all(holds(there, k) for k in self.keys[t]):
            return None
        same = SequenceMatcher(None, mine, there, autojunk=False).get_matching_blocks()
        return lo + max(0, same[0].b - same[0].a), sum(m.size for m in same) / len(mine)

    def scan(self, ws: list[bytes]) -> list[tuple[int, str, float, bool]]:
        """(start, label, share of the template's words, base) of every match."""
        have = set(ws)
        live = [t for t, must in enumerate(self.must) if must <= have]
        if not live:
            return []
        rare = {t: [w for w in self.order[t] if w in have][: None if self.entries[t][2] else self.rare_words] for t in live}
        wanted = set().union(*rare.values())
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(ws):
            if w in wanted:
                at[w].append(p)
        out = []
        for t in live:
            label, need, base = self.entries[t]
            if base:
                starts = set.intersection(*({p - i for p in at[w]} for w, places in self.places[t].items() for i in places))
                out += [(s, label, 1.0, True) for s in sorted(starts)]
                continue
            for starts in self.meeting(t, at, rare[t]):
                tried = [v for s in starts if (v := self.verified(t, ws, s)) and v[1] >= need]
                if tried:
                    start, share = max(tried, key=lambda v: (v[1], -v[0]))
                    out.append((start, label, share, False))
        return out


def license_scan(docs: DataFrame, index: RareTokenIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and matches (array of start word, label, share, base).

    n_base counts the places of phrases; first_word and last_word are their smallest and largest
    start, null without any. Labels are distinct, sorted and comma-joined. score is the largest
    share of a matched template, 1 for a phrase, 0 for none; matches stand by template, then place.
    Null texts count as empty: no words, empty labels. Whole texts are read; repeated rows give
    repeated results, an empty table none; other columns, whatever their names, stay behind."""
    index = index or RareTokenIndex()
    match = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("base", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", match)])

    def make():
        def work(ids: list, texts: list[str]) -> list:
            rows = []
            for d, text in zip(ids, texts, strict=True):
                ws = words_of(text)
                found = index.scan(ws)
                base = [m for m in found if m[3]]
                at = [m[0] for m in base]
                join = lambda ms: ",".join(sorted({m[1] for m in ms}))
                rows.append((d, len(ws), len(base), min(at, default=None), max(at, default=None), join(base), join(found), max((m[2] for m in found), default=0.0), [dict(zip(("start", "label", "share", "base"), m, strict=True)) for m in found]))
            return list(zip(*rows, strict=True))

        return work

    said = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,label:string,share:double,base:boolean>>"
    return map_texts(id_text(docs, id_col, text_col), make, schema, said)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
