import random
import re

from pyspark.sql import functions as F

from postloom.llm.licenses import LAP, OVERLAP, SPAN, _notices, fit, paragraphs, pieces, scan_licenses

PROSE = ["the quick brown fox jumps over it %d times" % i for i in range(60)] + ["we give permission to visit the software museum", "a license to drive is needed here"]


def plain_terms(text):
    text = text.lower().replace("licence", "license").replace("spdx-license-identifier:", "spdx ")
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text)


def plain_pieces(line):
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+(?=[\"'(]?[A-Z])", line):
        words = plain_terms(sentence)
        if len(words) <= SPAN:
            out += [words] if words else []
        else:
            out += [words[i : i + SPAN] for i in range(0, len(words) - LAP, SPAN - LAP)]
    return out


def grams(words):
    return {" ".join(p) for p in zip(words, words[1:])} if len(words) > 1 else set(words)


def plain_share(words, family):
    """The largest share of two-grams with a notice of the family, by its definition."""
    best, p = 0.0, grams(words)
    for f, text, name in _notices():
        if f == family:
            t, n = grams(plain_terms(text)), grams(plain_terms(name))
            there = all(x in p or (" " not in x and any(x in y.split(" ") for y in p)) for x in n)
            both = len(p & t)
            best = max(best, both / min(len(p), len(t)) if not n else both / len(t) if there else 0.0)
    return best


def test_pieces_hold_every_word(spark):
    rnd = random.Random(3)
    words = ["Alpha", "beta", "gamma.", "Delta!", "v. 2.0", "..a..b.c.", "licence", "(Epsilon", "x"]
    lines = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 47, 48, 49, 82, 83, 200)] + ["w " * n for n in (47, 48, 49, 62, 63, 82, 83, 5_000)] + ["", " . ", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", pieces(F.col("x")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: None if x is None else plain_pieces(x) for i, x in enumerate(lines)}
    assert all(sum(map(len, r.p)) >= len(plain_terms(lines[r.i])) for r in got if r.p is not None)


def test_notices_inside_prose(spark):
    """Notices at any place of long lines, tags, families of one line, and names that grant nothing."""
    long = " ".join(PROSE[:12])
    cases = {
        1: (f"{long}. Released under the MIT License.", "mit"),
        2: (f"{long} released under the MIT License {long}", "mit"),
        3: ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        4: ("The code is distributed under the terms of the MIT licence", "mit"),
        5: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        6: ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "apache-2.0,mit"),
        7: ("They read about the history of the MIT License in a museum", ""),
        8: ("goods are distributed under the terms of the agreement between both sides", ""),
        9: ("// SPDX-License-Identifier: MIT", "mit"),
        10: ("SPDX-License-Identifier: Foo-9.9", ""),
        11: ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
        12: ("\n".join(PROSE), ""), 13: (long, ""),
    }
    docs = spark.createDataFrame([(d, t) for d, (t, _) in cases.items()], "doc_id bigint, text string")
    assert {r.doc_id: r.families for r in scan_licenses(docs).collect()} == {d: f for d, (_, f) in cases.items()}


def test_overlap_of_all_lines(spark):
    """What is found shares enough with its family by a count in plain Python, over all texts of the small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = paragraphs(docs, fit(docs)).collect()
    assert found
    for r in found:
        shares = [plain_share(w, r.family) for w in plain_pieces(texts[r.doc_id].split("\n")[r.at])]
        assert r.overlap >= OVERLAP and any(abs(r.overlap - x) < 1e-12 for x in shares)


def test_families(spark):
    cases = {
        1: ("Some text\nLicensed under the Apache License, Version 2.0.\nmore text", "apache-2.0"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        3: ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,mit"),
        4: ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "mit"),
        5: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
        6: ("\n".join(PROSE), ""), 7: (None, ""), 8: ("", ""), 9: (" \n \n", ""), 10: ("word " * 60_000, ""), 11: ("The licensed plumber released the water under pressure.", ""),
    }
    rows = [(d, t) for d, (t, _) in cases.items()] + [(None, cases[1][0]), (1, cases[1][0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, family string, w int, features int")
    out = scan_licenses(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.families for r in got if r.doc_id is not None} == {d: f for d, (_, f) in cases.items()}
    assert [r.families for r in got if r.doc_id is None] == ["apache-2.0"]
    assert all((r.best_family is None) == (r.n_paragraphs == 0) and (r.n_paragraphs == 0 or r.best_probability >= 0.5) for r in got)
    assert [r.n_paragraphs for r in got if r.doc_id == 3] == [2]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert scan_licenses(empty).count() == 0
