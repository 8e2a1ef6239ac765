"""Licence scans by a positional index of rare words, in DataFrame functions only.

Templates are licence texts and notices with a label and mandatory key
phrases. Document frequencies over all texts give each template its rarest
words; their postings (word, template, position) are the index. Every file
looks up its own highest-IDF words of each template; postings are intersected
by relative position: places of several rare words that agree on where the
template would begin are a candidate, which counts if all key phrases stand
near their places. All of it happens within a file's row, without a shuffle,
in time that grows with the file's length; index, templates and phrases are
single constants of the plan, however many there are.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches


@dataclass(frozen=True)
class Template:
    """A licence text: label, words, key phrases that must stand in it, and by how many words they may be displaced."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    slack: int = 12

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Label and phrase of the base templates, which must match to the word.
BASE = tuple(Template(label, phrase, (phrase,), 0) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")))
#: Names of further licences, which must match to the word too.
NAMES = tuple(
    Template(label, phrase, (phrase,), 0)
    for label, phrase in (
        ("lgpl", "lesser general public license"),
        ("agpl", "affero general public license"),
        ("bsd", "bsd license"),
        ("mpl", "mozilla public license"),
        ("epl", "eclipse public license"),
        ("isc", "isc license"),
        ("cc", "creative commons attribution"),
    )
)
#: Wording of public licence texts and notices, in words; key phrases are parts of it.
TEXTS = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("distribute this software for any purpose with or without fee", "this permission notice appear in all copies"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("licensed under the apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("you can redistribute it and or modify", "under the terms of the gnu general public license"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("you can redistribute it and or modify", "under the terms of the gnu lesser general public license"),
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("you can redistribute it and or modify", "under the terms of the gnu affero general public license"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"),
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution and is available at",
        ("the accompanying materials are made available under the terms of the eclipse public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("released into the public domain", "anyone is free to copy modify publish use compile sell or distribute"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely"),
    ),
    Template(
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("any person or organization obtaining a copy", "to use reproduce display distribute execute and transmit the software"),
    ),
)
TEMPLATES = BASE + NAMES + TEXTS
#: Rare words that the index has of a template, that a file looks up of it, and that must agree on a start.
INDEXED, LOOKED_UP, AGREE = 8, 4, 2

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows that hold each template word: as many counts as there are such words."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in TEMPLATES for w in t.words})])
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_column(F.col(text)), vocabulary), "")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["w"]: r["n"] for r in found.collect()}
    return counts.pop("", 0), counts


def idf(rows: int, count: int) -> float:
    return math.log(1 + (rows - count + 0.5) / (count + 0.5))


def rare_words(counts: dict[str, int]) -> list[list[str]]:
    """The words of each template that the index has, rarest first; of equally rare ones the first in the text."""
    return [sorted(dict.fromkeys(t.words), key=lambda w: (counts.get(w, 0), t.words.index(w)))[:INDEXED] for t in TEMPLATES]


def _constant(value: object, schema: str) -> Column:
    """One literal of the plan, whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that later lambdas read and don't compute again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Bits of a start, and of a word's number.
_START, _WORD = 40, 10


def _candidates(rare: list[list[str]]) -> tuple[Column, Column]:
    """Sorted places of a file's rarest words, as template, start and word in one number; and how many words must agree."""
    number = {w: i for i, w in enumerate(sorted({w for own in rare for w in own}))}
    if len(number) >= 1 << _WORD:
        raise ValueError("too many index words")
    postings = {w: [[t, p] for t, own in enumerate(rare) if w in own for p, x in enumerate(TEMPLATES[t].words) if x == w] for w in number}
    index = _constant({w: {"n": number[w], "at": [{"t": t, "p": p} for t, p in places]} for w, places in postings.items()}, "map<string,struct<n:bigint,at:array<struct<t:int,p:int>>>>")
    agree = _constant([min(AGREE, len(own)) for own in rare], "array<int>")

    def places(x: Column) -> Column:
        entry = F.element_at(index, x["w"])
        own = F.filter(entry["at"], lambda e: (x["at"] >= e["p"]) & F.array_contains(F.get("top", e["t"]), x["w"]))
        return F.transform(own, lambda e: F.shiftleft(F.shiftleft(e["t"].cast("bigint"), _START).bitwiseOR((x["at"] - e["p"]).cast("bigint")), _WORD).bitwiseOR(entry["n"]))

    hits = F.sort_array(F.array_distinct(F.flatten(F.transform("index", places))))
    return hits, agree


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the IDF weight of the heaviest template found over that of
    the heaviest template there is, rounded to six places; 0 without any. Null and
    empty texts have no words and no labels. Rows are taken as they are,
    repeated and null ids included; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows, counts = document_frequencies(docs, text)
    rare = rare_words(counts)
    weight = [sum(idf(rows, counts.get(w, 0)) for w in own) for own in rare]
    heaviest = max(weight)
    vocabulary = sorted({w for own in rare for w in own})
    words = docs.select(F.col(id_column).alias("doc_id"), words_column(F.col(text)).alias("words"))
    # The positional index of a file holds its words that are rare in some template; most files have none and end here.
    index = F.filter(F.transform(F.col("words"), lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(vocabulary))
    indexed = _materialised(words, index=F.when(F.exists("words", lambda w: w.isin(vocabulary)), index))
    present = F.array_distinct(F.transform("index", lambda x: x["w"]))
    held = _materialised(indexed, present=present)
    top = F.transform(_constant(rare, "array<array<string>>"), lambda own: F.slice(F.filter(own, lambda w: F.array_contains(F.col("present"), w)), 1, LOOKED_UP))
    looked_up = _materialised(held, top=F.when(F.col("index").isNotNull(), top))
    hits, agree = _candidates(rare)
    sorted_hits = _materialised(looked_up, hits=hits)
    start = lambda h: F.shiftright(h, _WORD)
    # Sorted, hits of one template and start stand together, one for each word.
    enough = lambda h, i: (start(F.get("hits", i + F.get(agree, F.shiftright(h, _START + _WORD).cast("int")) - 1)) == start(h)) & ((i == 0) | (start(F.get("hits", i - 1)) != start(h)))
    candidates = _materialised(sorted_hits, candidates=F.transform(F.filter("hits", enough), lambda h: F.struct(F.shiftright(h, _START + _WORD).cast("int").alias("t"), start(h).bitwiseAND(F.lit((1 << _START) - 1)).cast("int").alias("s"))))
    keyed = _constant([[{"w": p.split(), "off": _offset(t, p), "slack": t.slack} for p in t.phrases] for t in TEMPLATES], "array<array<struct<w:array<string>,off:int,slack:int>>>")

    def stands(c: Column, p: Column) -> Column:
        """Whether a key phrase stands near its place."""
        at = c["s"] + p["off"]
        return F.exists(F.sequence(-p["slack"], p["slack"]), lambda d: F.when(at + d >= 0, F.slice("words", F.greatest(at + d, F.lit(0)) + 1, F.size(p["w"])) == p["w"]).otherwise(False))

    verified = F.filter("candidates", lambda c: F.forall(F.get(keyed, c["t"]), lambda p: stands(c, p)))
    found = _materialised(candidates, found=F.coalesce(verified, F.array().cast("array<struct<t:int,s:int>>")))
    base = F.transform(F.filter("found", lambda c: c["t"] < len(BASE)), lambda c: c["s"])
    label, heavy = _constant([t.label for t in TEMPLATES], "array<string>"), _constant([w / heaviest for w in weight], "array<double>")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label, x["t"])))), ",")
    return found.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"),
        F.array_max(base).cast("bigint").alias("last_word"),
        names(F.filter("found", lambda c: c["t"] < len(BASE))).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda c: F.get(heavy, c["t"]))), F.lit(0.0)), 6).alias("score"),
    )


def _offset(template: Template, phrase: str) -> int:
    """Where a phrase first stands in its template."""
    words, wanted = template.words, phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)


def scan_sql() -> str:
    """The same result as :func:`scan` over ``documents``, relation by relation."""
    templates = ", ".join(f"({t}, '{x.label}', {x.words!r})" for t, x in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, {_offset(x, p)}, {x.slack}, {p.split()!r})" for t, x in enumerate(TEMPLATES) for p in x.phrases)
    return f"""
with x as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda a: a <> '') as w from documents),
t as (select * from (values {templates}) as v(t, label, words)),
place as (select t, unnest(words) as word, generate_subscripts(words, 1) - 1 as p from t),
size as (select count(*) as rows from x),
dist as (select doc_id, unnest(list_distinct(w)) as word from x),
freq as (select word, count(*) as n from dist where word in (select word from place) group by word),
own as (select t, word, min(p) as first from place group by t, word),
rare as (select t, word, coalesce(n, 0) as n, row_number() over (partition by t order by coalesce(n, 0), first) as rank from own left join freq using (word) qualify rank <= {INDEXED}),
need as (select t, least({AGREE}, count(*)) as need, sum(ln(1 + (rows - n + 0.5) / (n + 0.5))) as weight from rare, size group by t),
top as (select doc_id, t, word from dist join rare using (word) qualify row_number() over (partition by doc_id, t order by rank) <= {LOOKED_UP}),
spot as (select * from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as b from x) where word in (select word from rare)),
hit as (select distinct doc_id, t, b - p as s, word from top join spot using (doc_id, word) join place using (t, word) where b >= p),
cand as (select doc_id, t, s from hit join need using (t) group by doc_id, t, s, need having count(*) >= need),
phrase as (select * from (values {phrases}) as v(t, off, slack, words)),
good as (select doc_id, t, s from cand join phrase using (t) join x using (doc_id) group by doc_id, t, s
  having bool_and(len(list_filter(range(-slack, slack + 1), lambda d: s + off + d >= 0 and w[s + off + d + 1 : s + off + d + len(words)] = words)) > 0)),
found as (select good.*, label, weight / (select max(weight) from need) as part from good join t using (t) join need using (t)),
r as (select doc_id, count(*) filter (t < {len(BASE)}) as n, min(s) filter (t < {len(BASE)}) as a, max(s) filter (t < {len(BASE)}) as b,
  coalesce(string_agg(distinct label, ',' order by label) filter (t < {len(BASE)}), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(part) as part from found group by doc_id)
select x.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, cast(a as bigint) as first_word, cast(b as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(part, 0), 6) as score from x left join r using (doc_id)
"""
