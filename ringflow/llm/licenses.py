"""License scan by a positional rare-token index.

Every licence template is a list of words. The index holds, for each template
word, its postings (template, offset), and for each word the inverse document
frequency over the whole corpus. A file is read once: of the licence words that
it holds, those of highest IDF are looked up, as many as it takes that no
template could count without one of them; the postings they give are intersected
by relative position (file position minus template offset), and a template counts
only where a mandatory key phrase is verified word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import id_text, map_rows, utf8

# Phrases every scan must report, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, template words, mandatory key phrases).
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license", ["gnu general public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        ["gnu general public license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu lesser general public license for more details",
        ["gnu lesser general public license"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0"],
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ["permission is granted to anyone to use this software for any purpose"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license v 2 0"],
    ),
]

#: Share of a template's IDF weight that must stand at one relative position.
MIN_WEIGHT = 0.6
#: Starts of a template that are weighed at once.
TOGETHER = 1 << 16

# Words are runs of 0-9, a-z and non-ASCII characters once A-Z is lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


class PositionalIndex:
    """Postings of the template words, by number of word, and their weights."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, base=BASE_PHRASES):
        self.number = {w: k for k, w in enumerate(sorted(idf))}
        self.idf = np.array([idf[w] for w in sorted(idf)])
        ids = lambda text: tuple(self.number[w] for w in text.encode().split())
        self.templates = [(label, np.array(ids(t)), [ids(k) for k in keys]) for label, t, keys in templates]
        self.weights = [float(self.idf[t].sum()) for _, t, _ in self.templates]
        self.base = [(ids(p), label) for p, label in base.items()]
        # per template its words, the rarest first, with all their offsets
        self.postings = []
        for _, words, _ in self.templates:
            rare = sorted(set(words.tolist()), key=lambda w: (-self.idf[w], w))
            self.postings.append([(w, np.flatnonzero(words == w), float(self.idf[w] * (words == w).sum())) for w in rare])

    def lookups(self, present: set[int]) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Per template that the words at hand can make up to MIN_WEIGHT: the rarest of them, until the others alone couldn't."""
        out = []
        for t, postings in enumerate(self.postings):
            need = MIN_WEIGHT * self.weights[t]
            left = sum(weight for w, _, weight in postings if w in present)
            if left < need * (1 - 1e-9) or not left:
                continue
            chosen = []
            for w, offsets, weight in postings:
                if left < need * (1 - 1e-9):
                    break
                if w in present:
                    chosen.append((w, offsets))
                    left -= weight
            out.append((t, chosen))
        return out

    def scan(self, words: list[bytes]) -> dict:
        """Places of the base phrases and labels of the templates found."""
        out = {"n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0}
        number = self.number
        present = {number[w] for w in number.keys() & set(words)}
        looked = self.lookups(present)
        phrases = [(p, label) for p, label in self.base if present.issuperset(p)]
        if not looked and not phrases:
            return out
        ids = np.array([number.get(w, -1) for w in words], np.int32)
        known: dict[tuple, np.ndarray] = {}

        def places(phrase: tuple) -> np.ndarray:
            """Where a phrase stands, worked out once for a file, from its rarest word."""
            if phrase not in known:
                k = max(range(len(phrase)), key=lambda i: self.idf[phrase[i]])
                at = np.flatnonzero(ids == phrase[k]) - k
                at = at[(at >= 0) & (at + len(phrase) <= len(ids))]
                for i, w in enumerate(phrase):
                    at = at[ids[at + i] == w]
                known[phrase] = at
            return known[phrase]

        base = [(places(p), label) for p, label in phrases]
        base = [(at, label) for at, label in base if len(at)]
        if base:
            out["n_base"] = sum(len(at) for at, _ in base)
            out["first_word"], out["last_word"] = int(min(at[0] for at, _ in base)), int(max(at[-1] for at, _ in base))
            out["base"] = {label for _, label in base}
            out["labels"], out["score"] = set(out["base"]), MIN_WEIGHT
        for t, chosen in looked:
            label, template, keys = self.templates[t]
            if not all(len(places(key)) for key in keys):
                continue
            # relative positions at which one of the rare words stands
            starts = np.unique(np.concatenate([(np.flatnonzero(ids == w)[:, None] - offsets[None, :]).ravel() for w, offsets in chosen]))
            for lo in range(0, len(starts), TOGETHER):
                s = starts[lo : lo + TOGETHER]
                got = np.zeros(len(s))
                for k, w in enumerate(template.tolist()):
                    at = s + k
                    inside = (at >= 0) & (at < len(ids))
                    got += np.where(inside & (ids[np.where(inside, at, 0)] == w), self.idf[w], 0.0)
                share = got / self.weights[t]
                good = share >= MIN_WEIGHT - 1e-9
                for key in keys:
                    at = places(key)
                    nearest = np.searchsorted(at, s)
                    good &= (nearest < len(at)) & (at[np.minimum(nearest, len(at) - 1)] + len(key) <= s + len(template))
                if good.any():
                    out["labels"].add(label)
                    out["score"] = max(out["score"], float(share[good].max()))
        out["score"] = min(1.0, round(out["score"], 6))
        return out


def template_words(templates=TEMPLATES, base=BASE_PHRASES) -> set[bytes]:
    return {w for _, t, keys in templates for w in " ".join([t, *keys]).encode().split()} | {w for p in base for w in p.encode().split()}


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """(word, df) over all documents for the template words, and ('', number of documents)."""

    def make():
        def work(rows: dict) -> dict:
            df: dict[bytes, int] = defaultdict(int)
            for text in rows["text"]:
                df[b""] += 1
                for w in vocabulary.intersection(license_words(text)):
                    df[w] += 1
            return {"word": [w.decode() for w in df], "df": list(df.values())}

        return work

    return map_rows(id_text(docs), make, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``templates`` is a fixed list, so the frequencies that come to the driver are
    one row for each of its words, however large the corpus. A null text counts
    as empty: no words, no labels, score 0, first_word and last_word null. Null
    or repeated ids and repeated rows are kept as they are; an empty table gives
    an empty result; other columns are ignored.
    """
    docs = id_text(docs, id_col, text_col)
    counts = {r["word"].encode(): r["df"] for r in document_frequencies(docs, template_words(templates, base)).collect()}
    n = counts.pop(b"", 0)
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 0.01 for w in template_words(templates, base)}
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number for each template word

    def make():
        index = PositionalIndex(shared.value, templates, base)

        def work(rows: dict) -> dict:
            out: dict[str, list] = defaultdict(list)
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = license_words(text)
                r = index.scan(words)
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                for k in ("n_base", "first_word", "last_word", "score"):
                    out[k].append(r[k])
                out["base_labels"].append(",".join(sorted(r["base"])))
                out["labels"].append(",".join(sorted(r["labels"])))
            return out

        return work

    return map_rows(docs, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def oracle_sql(templates=TEMPLATES, base=BASE_PHRASES) -> str:
    """The same by joins of all words with all template words."""
    phrases = sorted({*base, *(k for _, _, keys in templates for k in keys)})
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    template_rows = [(t, k, w) for t, (_, text, _) in enumerate(templates) for k, w in enumerate(text.split())]
    phrase_rows = [(p, k, w, len(text.split())) for p, text in enumerate(phrases) for k, w in enumerate(text.split())]
    key_rows = [(t, phrases.index(k)) for t, (_, _, keys) in enumerate(templates) for k in keys]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tw(t, k, word) AS (VALUES {listed(template_rows)}),
tl(t, label) AS (VALUES {listed([(t, label) for t, (label, _, _) in enumerate(templates)])}),
pw(p, k, word, n) AS (VALUES {listed(phrase_rows)}),
tk(t, p) AS (VALUES {listed(key_rows)}),
bl(p, label) AS (VALUES {listed([(phrases.index(p), label) for p, label in base.items()])}),
v AS (SELECT word FROM tw UNION SELECT word FROM pw),
x AS MATERIALIZED (SELECT rid, i, word FROM (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM v)),
idf AS (SELECT v.word, ln((1 + (SELECT COUNT(*) FROM d)) / (1 + COALESCE(c.df, 0))) + 0.01 AS idf FROM v LEFT JOIN (SELECT word, COUNT(DISTINCT rid) AS df FROM x GROUP BY word) c ON v.word = c.word),
ti AS (SELECT t, k, word, idf FROM tw JOIN idf USING (word)),
tt AS (SELECT t, SUM(idf) AS weight, COUNT(*) AS n FROM ti GROUP BY t),
hit AS (SELECT rid, x.i - ti.k AS s, ti.t, SUM(ti.idf) / ANY_VALUE(tt.weight) AS share, ANY_VALUE(tt.n) AS n FROM x JOIN ti USING (word) JOIN tt ON ti.t = tt.t GROUP BY rid, x.i - ti.k, ti.t HAVING SUM(ti.idf) / ANY_VALUE(tt.weight) >= {MIN_WEIGHT} - 1e-9),
pl AS MATERIALIZED (SELECT rid, p, x.i - pw.k AS pos, ANY_VALUE(n) AS n FROM x JOIN pw USING (word) GROUP BY rid, p, x.i - pw.k HAVING COUNT(*) = ANY_VALUE(n)),
ok AS (SELECT h.rid, h.t, h.s, ANY_VALUE(h.share) AS share FROM hit h JOIN tk ON h.t = tk.t JOIN pl ON pl.rid = h.rid AND pl.p = tk.p AND pl.pos >= h.s AND pl.pos + pl.n <= h.s + h.n
  GROUP BY h.rid, h.t, h.s HAVING COUNT(DISTINCT tk.p) = (SELECT COUNT(*) FROM tk k2 WHERE k2.t = h.t)),
b AS (SELECT rid, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl JOIN bl USING (p) GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM pl JOIN bl USING (p) UNION SELECT rid, label FROM ok JOIN tl USING (t)) GROUP BY rid),
m AS (SELECT rid, MAX(share) AS share FROM ok GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(COALESCE(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  COALESCE(b.base_labels, '') AS base_labels, COALESCE(l.labels, '') AS labels,
  CAST(ROUND(LEAST(1.0, GREATEST(CASE WHEN b.rid IS NULL THEN 0.0 ELSE {MIN_WEIGHT} END, COALESCE(m.share, 0.0))), 6) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.rid = b.rid LEFT JOIN l ON d.rid = l.rid LEFT JOIN m ON d.rid = m.rid
"""
