"""License scans, token files, quality classifier."""

import zlib

import numpy as np
import pandas as pd
import pytest
from llm_fixtures import SF01, empty, odd  # noqa: F401

from setsift.llm import licenses, quality, token_files

TOK = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_template_automaton_takes_optional_and_replaceable_regions():
    t = licenses.Template('<<beginOptional>>the <<endOptional>>work by <<var;name="who";min="1";max="2">> is free<<beginOptional>> for all<<endOptional>>')
    match = lambda s, at=0: t.match(s.encode().split(), at)
    assert match("the work by ann is free") == 6
    assert match("work by ann lee is free for all") == 8
    assert match("work by is free") is None
    assert match("work by a b c is free") is None
    assert match("work by ann is not free") is None
    assert match("x work by ann is free", 1) == 6


def test_template_automaton_takes_one_of_several_wordings():
    t = licenses.Template("by <<beginAny>>one<<or>>two <<beginOptional>>or <<endOptional>>more<<endAny>> of us")
    match = lambda s: t.match(s.encode().split(), 0)
    assert (match("by one of us"), match("by two more of us"), match("by two or more of us")) == (4, 5, 6)
    assert match("by of us") is None and match("by one two more of us") is None and match("by two of us") is None


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
FSF = "redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
WORDINGS = [
    (MIT, "mit-text"),
    (MIT.replace("\n", "\n// "), "mit-text"),
    (MIT.replace("sell copies", "keep copies"), ""),
    (BSD + AS_IS, "bsd-2-clause-text"),
    (BSD + NAME + AS_IS, "bsd-3-clause-text"),
    (BSD.replace("1.", " *").replace("2.", " *") + NAME.replace("3.", " *") + AS_IS, "bsd-3-clause-text"),
    (BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the X Group.\n" + NAME + AS_IS, "bsd-4-clause-text"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc-text"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\"", "0bsd-text"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file', "apache-2.0-notice"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL", "mpl-2.0-header"),
    (FSF.format("General", 2), "gpl-2.0-header"),
    (FSF.format("General", 3), "gpl-3.0-header"),
    (FSF.format("Lesser General", "2.1"), "lgpl-2.1-header"),
    (FSF.format("Lesser General", 3), "lgpl-3.0-header"),
    (FSF.format("Library General", 2), "lgpl-2.0-header"),
    (FSF.format("Affero General", 3), "agpl-3.0-header"),
    ("under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation.", "gpl-2.0-header"),
    ("under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation", "gpl-2.0-header"),
    ("Licensed under the GNU Lesser General Public License v2.1", "lgpl-2.1-notice"),
    ("licensed under CC BY-SA 3.0", "cc-by-sa-3.0-notice"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0-notice"),
    ("licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License", "cc-by-nc-nd-3.0-notice"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0-notice"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights", "cc0-1.0-notice"),
]


@pytest.mark.parametrize("text, label", WORDINGS)
def test_wording_of_common_licenses(text, label):
    s = licenses.scan(f"Some words before.\n{text}\nand after", licenses.PHRASES, licenses.TEMPLATES)
    own = sorted(x.split(":")[0] for x in s["spans"].split())
    assert own == [label] * bool(label) and (s["score"] == 1.0) == bool(label)


def test_scan_counts_places_and_labels(odd):
    rows = {(r["doc_id"], r["n_words"]): r for r in licenses.license_scan(odd).collect()}
    r = rows[1, 10]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 0, 7, "cc-by,gpl,reserved")
    assert sum(len(x) for x in [rows]) >= 10 and rows[2, 0]["score"] == 0.0 and rows[3, 0]["first_word"] is None
    s = licenses.scan("This file is released under the MIT License.", licenses.PHRASES, licenses.TEMPLATES)
    assert (s["labels"], s["spans"], s["score"]) == ("mit-notice", "mit-notice:0-8", 1.0)


def test_scan_of_an_empty_table(empty):
    assert licenses.license_scan(empty).count() == 0


def _by_library(rows):
    from tokenizers import Tokenizer

    model, start, out = Tokenizer.from_file(TOK), 0, []
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = _by_library(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    got = sorted(tuple(r) for r in token_files.token_table(docs, TOK, 2).collect())
    assert got == want


def test_token_files_of_odd_rows(odd, empty):
    got = token_files.token_table(odd, TOK, 2).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in got), key=key)
    rows = odd.select("doc_id", "text").collect()
    plain = {(d, n, c) for d, _, n, c in _by_library([(r[0], r[1]) for r in rows])}
    assert {(d, n, c) for d, _, n, c in got} == plain and len(got) == len(rows)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert token_files.token_table(empty, TOK, 2).count() == 0


def test_pieces_of_letters_and_others():
    """Letters of many scripts, marks, digits and emoji, cut, remembered and forgotten, against whole texts."""
    import random

    from tokenizers import Tokenizer

    model, enc = Tokenizer.from_file(TOK), token_files.Encoder(TOK)
    assert enc.direct
    rng = random.Random(4)
    alphabet = ["a", "Zu", "the", "ß", "é", "e\u0301", "語", "ا", "क्", "'s", "don't", "12", "3", "!", "...", "\u200b", "😀", "-", "(", "x" * 50, "\x00", "ǅ", "ʰ", "²"]
    texts = ["", "a", "."] + ["".join(rng.choice(alphabet) if rng.random() < 0.7 else rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    want = [np.array([*model.encode(t, add_special_tokens=False).ids, 2], enc.dtype).tobytes() for t in texts]
    assert sum(map(enc.can_be_cut, texts)) > 20
    assert list(enc.texts(texts, 2)) == want and list(enc.texts(texts[::-1], 2)) == want[::-1]
    assert [next(enc.texts([t], 2)) for t in texts] == want


def test_special_tokens_at_any_place():
    from tokenizers import Tokenizer

    model, enc = Tokenizer.from_file(TOK), token_files.Encoder(TOK)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    assert special
    texts = [f"{a}{t}{b}" for t in [*special, "<|", "|>", "<s>"] for a in ("", "w", "w ", "end of it", "w.\n") for b in ("", "z", " z", ".", "\n")]
    want = [np.array([*model.encode(t, add_special_tokens=False).ids, 2], enc.dtype).tobytes() for t in texts]
    assert list(enc.texts(texts, 2)) == want
    assert list(enc.texts(texts[::-1], 2)) == want[::-1]


def test_texts_with_other_white_space_are_encoded_whole():
    from tokenizers import Tokenizer

    model, enc = Tokenizer.from_file(TOK), token_files.Encoder(TOK)
    texts = ["x\n\u00a0\u00a0y", "x\n\u00a0\u3000y", "a\tb\n\u00a0\nc", "\u00a0y", "y\u00a0"]  # the third: a word too many, a word too few
    texts += [t.replace("_", c) for c in "\u00a0\t\r\x0b\x0c\x1c\x85\u1680\u2003\u2028\u202f\u205f\u3000" for t in ("x\n__y", "x\n_\ny", "x_\ny", "x _y", "x_ y", "x__y", "_x", "x_")]
    assert not enc.can_be_cut(texts[0]) and enc.can_be_cut("x y\nz") and not enc.can_be_cut("x\x00y")
    want = [np.array([*model.encode(t, add_special_tokens=False).ids, 2], enc.dtype).tobytes() for t in texts]
    assert list(enc.texts(texts, 2)) == want
    assert [next(token_files.Encoder(TOK).texts([t], 2)) for t in texts] == want


def test_token_folder_must_be_mounted(spark):
    with pytest.raises(ValueError):
        token_files.mounted("hdfs://x/y")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    table = quality.quality_table(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    table = table[table.held_out]
    assert len(table) > 500 and (table.predicted == table.quality).mean() > 0.98
    good, bad = table.score[table.quality == 1], table.score[table.quality == 0]
    assert np.mean(good.sample(500, replace=True, random_state=1).to_numpy() > bad.sample(500, replace=True, random_state=1).to_numpy()) > 0.9


def test_scores_do_not_depend_on_neighbours_in_a_batch():
    import pyarrow as pa

    texts = ["good text here", "", None, "x", "a b", " lead", "long " * 1000, "é ü"]
    model = quality.train([quality.bag(t, quality.Settings(bits=10)) for t in ["good text", "bad !!! ***"] * 5], [1, 0] * 5, quality.Settings(bits=10))
    whole = quality.score_texts(pa.array(texts), model)
    assert np.allclose(whole, [quality.score_texts(pa.array([t], pa.string()), model)[0] for t in texts])
    assert whole[1] == whole[2]


def test_features_are_words_pairs_repetitions_and_ngrams():
    import pyarrow as pa

    from setsift.llm._common import utf8

    s = quality.Settings(bits=16)
    got = [(b.tolist(), d.tolist()) for b, d in quality.features(*utf8(pa.array(["aa aa b", "", "aa b"])), s)]
    words, pairs, again, threes, _ = got
    assert words[1] == [0, 3, 3, 5] and words[0][0] == words[0][1] == words[0][3] and words[0][2] == words[0][4]
    assert pairs[1] == [0, 2, 2, 3] and pairs[0][1] == pairs[0][2] != pairs[0][0]
    assert again == ([quality.AGAIN % (1 << 16)], [0, 1, 1, 1])
    assert threes[1] == [0, 5, 5, 8]  # " aa" "aa " twice, " b "


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_table(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_table(empty, labels).count() == 0
    none = quality.quality_table(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {1} and {r["score"] for r in none} == {0.5}


def test_held_out_fold_is_never_learnt(spark):
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": range(300), "quality": [i % 2 for i in range(300)]}))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(300), "text": [str(i) for i in range(300)]}))
    rows = quality.training_rows(docs, labels, quality.Settings()).collect()
    assert len(rows) > 150 and all(zlib.crc32(r["text"].encode()) % 3 != 1 for r in rows)
