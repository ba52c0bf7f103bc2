"""License labels against a plain scan."""

from __future__ import annotations

import re

from utilscope.llm.license_scan import Scan, scan_licenses, words_of


def plain(text, scan):
    text = text or ""
    words = words_of(text)
    places, labels, share = [], set(), 0.0
    for phrase, label in scan.phrases.items():
        phrase = words_of(phrase)
        found = [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
        places += found
        labels |= {label} if found else set()
    base = ",".join(sorted(labels))
    for label, tokens in scan.template_sets():
        for line in text.split("\n"):
            held = len(set(words_of(line)) & set(tokens))
            if 100 * held >= scan.percent * len(tokens):
                labels.add(label)
                share = max(share, held / len(tokens))
    return (len(words), len(places), min(places, default=None), max(places, default=None), base,
            ",".join(sorted(labels)), 1.0 if places else share)


TEXTS = [
    "", None, "Under the MIT License", "x\nReleased under the MIT license. y\nunder the mit license",
    "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "apache license, version 2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "this work is licensed under the gnu general public license", "mit\nlicense under the",
    "under the mit\nlicense", "Kunder the mit license İ", "cc by nc cc by nc", "é under the mit licenseé",
    "Permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files",
    "z " * 30_000 + "under the mit license", "under the mit license " * 200,
]


def test_labels_places_and_scores(documents):
    scan = Scan()
    pairs = list(enumerate(TEXTS)) + [(2, TEXTS[2]), (None, TEXTS[3])]
    rows = scan_licenses(documents(pairs), scan).collect()
    got = sorted((str(r["doc_id"]), *map(str, r[1:])) for r in rows)
    assert got == sorted((str(i), *map(str, plain(t, scan))) for i, t in pairs)


def test_an_empty_table_and_no_python_in_the_plan(documents):
    found = scan_licenses(documents([]))
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_repeated_word_phrase_is_found_at_every_place(documents):
    scan = Scan(phrases={"a b a": "x"}, templates={"t": ["zz yy"]})
    row = scan_licenses(documents([(1, "a b a b a")]), scan).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (2, 0, 2)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
APACHE = """# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices_are_found(documents):
    narrow = "This work is\nlicensed under\nthe GNU\r\nGeneral Public\nLicense,\nversion 3."
    texts = {1: MIT, 2: APACHE, 3: BSD, 4: "text\n" * 300 + MIT + "\n" + BSD, 5: narrow, 6: "a " * 5000 + APACHE}
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(documents(list(texts.items()))).collect()}
    assert got == {1: ("mit", 1.0), 2: ("apache-2", 1.0), 3: ("bsd", 1.0), 4: ("bsd,mit", 1.0),
                   5: ("gpl-3", 1.0), 6: ("apache-2", 1.0)}


def test_a_wrapped_notice_of_a_given_template_is_found(documents):
    scan = Scan(templates={"gpl-3": [" ".join(GPL.split())]})
    got = scan_licenses(documents([(1, GPL), (2, GPL.replace("\n", "\n// ")), (3, GPL[:150])]), scan).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {1: ("gpl-3", 1.0), 2: ("gpl-3", 1.0), 3: ("", 0.0)}


def test_words_far_apart_on_several_lines_are_no_notice(documents):
    apart = ("\n" + "filler " * 12 + "\n").join(words_of("licensed under CC BY-NC 4.0"))
    assert scan_licenses(documents([(1, apart)])).first()["labels"] == ""
