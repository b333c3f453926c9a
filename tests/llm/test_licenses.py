import re
import textwrap

import duckdb
import pytest

from larkspur.llm import licenses as L

def wrapped(text, mark="", width=72):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."""
BSD = "Copyright 2020, Someone. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
APACHE = 'Licensed under the terms below; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://x.org/l Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at x."
WRAPPED = [("mit", MIT), ("bsd", BSD), ("apache", APACHE), ("gpl", GPL), ("mpl", MPL)]
NOTICES = [
    "Some text.\nReleased under the MIT License.\nMore of it. The mit-license",
    "Licensed under CC BY-NC 4.0.",
    "licensed\tunder the APACHE license, version 2.0 and the Apache License",
    "general public licence, general PUBLIC license; mit license mit license",
    "This program is free software: you can redistribute it or modify it under the terms of the GNU General Public License published by the Free Software Foundation",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Redistribution and use in source and binary forms, with or without modification are permitted provided that these conditions are met",
    "\n\nLicensed under CC BY 4.0\nLicensed under\nCC BY-NC 4.0",
    "unlicensed underwear the mitx licensed",
    *(wrapped(x, mark) for _, x in WRAPPED for mark in ("", " * ", "# ", "// ")),
    "filler words here " * 400 + wrapped(BSD) + " and more" * 700 + wrapped(MIT, "-- "),
]


def slow(text, templates=L.TEMPLATES, phrases=L.PHRASES, threshold=L.THRESHOLD):
    words = L.words_of(text or "")
    places = [(k, label) for label, phrase in phrases.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p]
    matches = set()
    for number, (label, notice) in enumerate(templates):
        members, length = set(L.words_of(notice)), len(L.words_of(notice))
        for k in range(len(words)):
            own = set(words[k : k + length])
            if len(own & members) / len(members) >= threshold:
                matches.add((number, label, k, len(own & members) / len(members)))
    base = sorted({label for _, label in places})
    at = [k for k, _ in places]
    score = 1.0 if places else max([0.0, *(x[3] for x in matches)])
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x[1] for x in matches)})), score, matches


@pytest.fixture(scope="module")
def scanned(spark, docs):
    own = spark.createDataFrame([(1000 + k, x) for k, x in enumerate(NOTICES)], "doc_id long, text string")
    return docs.unionByName(own, allowMissingColumns=True).cache()


def digest(found):
    return sorted((repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)), round(r.score, 9)) for r in found)


def test_like_brute_force(scanned):
    found = L.scan(scanned).collect()
    want = [(r.doc_id, *slow(r.text)) for r in scanned.collect()]
    assert digest(found) == sorted((repr(x[:7]), round(x[7], 9)) for x in want)
    pairs = sorted((repr(r.doc_id), sorted(tuple(m) for m in r.matches)) for r in found)
    assert pairs == sorted((repr(x[0]), sorted(x[8])) for x in want)
    assert sum(bool(r.matches) for r in found) >= 5 + len(WRAPPED) * 4


def test_wrapped_notices(scanned):
    """Notices wrapped at 72 columns, with and without comment marks, have their labels, and no wrong ones."""
    found = {r.doc_id: r.labels for r in L.scan(scanned).collect()}
    first = 1000 + NOTICES.index(wrapped(MIT))
    assert [found[first + k] for k in range(len(WRAPPED) * 4)] == [label for label, _ in WRAPPED for _ in range(4)]
    assert found[1001] == "cc-by-nc" and found[1007] == "cc-by,cc-by-nc" and found[1000 + len(NOTICES) - 1] == "bsd,mit"


def test_pieces_of_long_texts(scanned):
    """Blocks that reach over the pieces' ends are found once."""
    pairs = lambda **options: sorted((repr(r.doc_id), sorted(tuple(m) for m in r.matches)) for r in L.scan(scanned, **options).collect())
    assert pairs(piece=7) == pairs()


def test_any_threshold_and_templates(scanned):
    """Every pair over the threshold is found whatever the filters."""
    templates = (("a", "the of and thing"), ("b", "one"), ("c", "x 42 end the of"), ("d", "licensed under the"))
    for threshold in (0.3, 0.5, 0.75, 1.0):
        got = digest(L.scan(scanned, templates=templates, threshold=threshold).collect())
        assert got == sorted((repr((r.doc_id, *w[:6])), round(w[6], 9)) for r in scanned.collect() for w in [slow(r.text, templates, threshold=threshold)])


def test_only_builtin_operations(scanned):
    plan = L.scan(scanned)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql_gives_the_same(scanned):
    db = duckdb.connect()
    table = scanned.select("doc_id", "text").toArrow()  # DuckDB reads it by name
    db.register("documents", table)
    got = sorted((repr(x[:7]), round(x[7], 9)) for x in db.execute(L.oracle_sql()).fetchall())
    assert got == digest(L.scan(scanned).collect())


def test_nothing(no_docs):
    assert L.scan(no_docs).count() == 0
