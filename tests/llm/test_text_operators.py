"""Quality rules, line dedup, licence scans, packing, toxicity on odd rows, empty tables and against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import rows_of
from tests.llm import brute

from weftline.llm import licenses, linededup, packing, quality, toxicity
from weftline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)


def on_odd(spark, df, tmp, module, columns):
    """The module's query on a folder that holds df as documents, and its SQL there."""
    import duckdb

    df.write.parquet(f"{tmp}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp}/documents.parquet/*.parquet'")
    got = module.query(spark, str(tmp))
    assert got.columns == columns
    return got.toPandas(), c.sql(module.ORACLE_SQL).df()


def test_quality_of_odd_rows(spark, odd, tmp_path):
    got, want = on_odd(spark, odd, tmp_path, quality, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert rows_of(got) == rows_of(want)
    assert got.set_index("doc_id").loc[100, "n_words"] == 0 and not got.set_index("doc_id").loc[100, "kept"]


def test_quality_keeps_other_columns(odd, empty):
    kept = quality.kept(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert quality.kept(empty).count() == 0


def test_stop_words_count_for_latin_letters_only(spark):
    russian = " ".join("текст" + "абвгдежзик"[i // 10] + "лмнопрстуф"[i % 10] for i in range(80))
    shouted = " ".join(f"{w} word{chr(97 + i % 26)}{i}" for i, w in enumerate(["The,", "OF.", "«And»", "(to)"] * 20))
    none = " ".join(f"zorp{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    df = quality.judged(spark.createDataFrame([(1, russian), (2, shouted), (3, none)], "doc_id long, text string"))
    assert {r.doc_id: (r.kept, r.failed_rules) for r in df.collect()} == {1: (True, []), 2: (True, []), 3: (False, ["stop_word_ratio"])}


def test_repeated_windows(spark):
    text = "a b c d e a b c d e x"  # the window a-e twice: ten words in it
    assert quality.counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_repeat_words"] == 10


def test_lines_of_odd_rows(spark, odd, tmp_path):
    got, want = on_odd(spark, odd, tmp_path, linededup, ["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text_sha256"])
    assert rows_of(got) == rows_of(want) and got["n_removed_lines"].sum() > 0


def test_line_dedup_keeps_first_and_other_columns(spark, odd, empty):
    df = linededup.deduped(odd)
    assert set(odd.columns) <= set(df.columns) and df.count() == odd.count()
    assert linededup.deduped(empty).count() == 0
    text = "\n".join(f"line number {i}" for i in range(40))
    two = linededup.deduped(spark.createDataFrame([(2, text), (1, text), (3, "x\n" + text)], "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_removed_chunks) for r in two.collect()} == {1: (text, 0), 2: ("", 1), 3: ("x", 1)}


def deduped_texts(docs, **options):
    return {r.doc_id: r.text for r in linededup.deduped(docs, **options).collect()}


def test_planted_passages_go_wherever_they_begin(spark):
    passages = [[f"passage {n}.{k} line {i} of it" for i in range(n)] for n in range(2, 9) for k in range(8)]
    rows = []
    for c in range(3):
        for p, lines in enumerate(passages):
            around = [f"own line {c} {p} {i}" for i in range(2 + (p + c) % 5)]
            at = (p * (c + 1)) % (len(around) + 1)
            rows.append((len(rows), "\n".join(around[:at] + lines + around[at:])))
    left = deduped_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    for doc, text in rows:
        kept = [x for x in text.split("\n") if doc < len(passages) or not x.startswith("passage")]
        assert left[doc] == "\n".join(kept)


def test_passages_of_odd_rows(spark, data, odd, odd_rows):
    assert deduped_texts(odd) == brute.without_passages(odd_rows)
    runs = [(1, "a\na"), (2, "b\nb\nb"), (3, "c\nc\nc\nc\nc"), (4, None), (5, "x\n\na\n \na\n\ny"), (6, "\n\n\n"), (7, "\n\n"), (8, "q\n\na")]
    want = {1: "a\na", 2: "b\nb\nb", 3: "c\nc", 4: "", 5: "x\n\ny", 6: "\n\n\n", 7: "\n\n", 8: "q\n\na"}
    assert brute.without_passages(runs) == want and deduped_texts(spark.createDataFrame(runs, "doc_id long, text string")) == want
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert deduped_texts(docs) == brute.without_passages([(r.doc_id, r.text) for r in docs.collect()])


def test_the_rolling_hash_sets_the_boundaries(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\ny\na\nb\nc\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped_texts(docs, roll=2)[2] == "x\ny" and deduped_texts(docs, roll=3)[2] == "x\nb\nc\ny" and deduped_texts(docs, roll=5)[2] == rows[1][1]
    hashes = docs.select(linededup.rolling_hashes(F.split("text", "\n"), F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1)).alias("h")).collect()
    one, two = hashes[0].h, hashes[1].h
    assert len(one) == 3 and two[1] == one[1] and two[4:] == one and len(set(one)) == 3


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    shared, own = "\n".join(f"shared line {i}" for i in range(6)), "\n".join(f"line of its own {i}" for i in range(12))
    docs = spark.createDataFrame([(1, shared), (2, shared), (2, own), (None, shared), (3, "x\n" + own)], "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in linededup.deduped(docs).collect()]
    assert sorted(left, key=repr) == sorted([(1, shared), (2, ""), (2, own), (None, shared), (3, "x")], key=repr)


def test_pipeline_removes_short_passages(spark, data):
    """Two lines between others."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"first {i}\nshared line\nand its next\nlast {i}", "en", "s", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, data).collect()}
    assert left == {0: rows[0][1]} | {i: f"first {i}\nlast {i}" for i in (1, 2, 3)}


def test_licenses(spark, odd, empty):
    texts = ["Text. Licensed under the Apache License, Version 2.0.", "MIT\nReleased under the MIT License. This work is licensed under the GNU General Public License, version 3.", "no license here", None]
    df = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.licenses for r in df.collect()} == {0: ["Apache-2.0"], 1: ["GPL-3.0-only", "MIT"], 2: [], 3: []}
    full = ". ".join(licenses.SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_asis"))
    assert licenses.scanned(spark.createDataFrame([(1, full + " .")], "doc_id long, text string")).first().licenses == ["MIT"]
    partial = licenses.SENTENCES["mit_grant"] + "."
    assert licenses.scanned(spark.createDataFrame([(1, partial)], "doc_id long, text string")).first().licenses == []
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(empty).count() == 0


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This {} is free software{} you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This {} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""


def test_licenses_wrapped_over_lines(spark):
    gpl = lambda what, name, version, mark: GPL.format(what, mark, name, "," if mark == ":" else ";", version, what)
    texts = [
        (APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD.replace("1. ", "* ").replace("2. ", "* "), "BSD-2-Clause"),
        (gpl("program", "General Public License", "3", ":"), "GPL-3.0-or-later"), (gpl("program", "General Public License", "2", ";"), "GPL-2.0-or-later"),
        (gpl("library", "Lesser General Public\nLicense", "2.1", ";"), "LGPL-2.1-or-later"), (gpl("program", "Affero General Public License", "3", ":"), "AGPL-3.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"), ("This is free and unencumbered software released into the\npublic domain.", "Unlicense"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ]
    rows = [(lead + t.replace("\n", end + lead), want) for t, want in texts for lead, end in (("", "\n"), ("", "\r\n"), (" * ", "\n"), ("// ", "\n"), ("# ", "\n"))]
    got = licenses.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"))
    assert {r.doc_id: r.licenses for r in got.collect()} == {i: [want] for i, (_, want) in enumerate(rows)}
    cut = [APACHE.replace("Licensed under", "Not licensed under").replace("AS IS", "AS WAS"), MIT.replace("without restriction", "with restrictions"), "x|licensed under|the MIT license"]
    assert [r.licenses for r in licenses.scanned(spark.createDataFrame(list(enumerate(cut)), "doc_id long, text string")).orderBy("doc_id").collect()] == [[], [], []]


BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
HEADS = (
    ("                                 Apache License\n                           Version 2.0, January 2004\n", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0-only"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0-only"),
    ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL-3.0-only"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n", "LGPL-2.1-only"),
    ("Mozilla Public License Version 2.0\n==================================\n", "MPL-2.0"),
    ("Attribution-ShareAlike 4.0 International\n", "CC-BY-SA-4.0"),
    ("# SPDX-License-Identifier: MIT\n", "MIT"),
)


def test_rules_use_up_their_identifiers_longest_first(spark):
    other = BSD3.replace("Neither the name of the copyright holder nor the names of its\n   contributors", "The name of the author").replace("may be used", "may not be used")
    texts = [BSD3, BSD3 + "\n" + BSD, BSD, other, *[h for h, _ in HEADS]]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [["BSD-3-Clause"], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-3-Clause"], *[[x] for _, x in HEADS]]


def test_own_sentences_and_rules(spark):
    docs = spark.createDataFrame([(1, "Hello. You owe me\na beer. And a coke."), (2, "You owe me a beer")], "doc_id long, text string")
    got = licenses.scanned(docs, sentences={"beer": "you owe me a beer", "coke": "and a coke"}, rules=(("Beerware", ("beer",)), ("Drinks", ("beer", "coke"))))
    assert {r.doc_id: r.licenses for r in got.collect()} == {1: ["Drinks"], 2: ["Beerware"]}


def test_license_texts_and_their_sql(spark, tmp_path):
    texts = [APACHE, MIT, BSD, BSD3, BSD3 + BSD, "x. " + MIT + "\nThis work is licensed under the GNU General Public License, version 3.", None, "", *[h for h, _ in HEADS]]
    got, want = on_odd(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, licenses, ["doc_id", "n_sentences", "sentence_ids", "licenses"])
    assert rows_of(got) == rows_of(want) and (got["licenses"] != "").sum() == len(texts) - 2


EVERYDAY = (
    ("This project is licensed under the MIT License.", "MIT"), ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"), ("Licensed under the MIT license (see LICENSE).", "MIT"),
    ("This project is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Some Tool is released under the\nGNU General Public License v3.0 or later.", "GPL-3.0-or-later"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("// SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: LGPL-2.1-only\nimport x", "LGPL-2.1-only"),
    ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) OR BSD-2-Clause */", "BSD-2-Clause,GPL-2.0-or-later"), ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "Apache-2.0"), ("SPDX-License-Identifier: MPL-2.0 AND (MIT OR Zlib)", "MIT,MPL-2.0,Zlib"),
    ("Text. Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.", "CC-BY-ND-3.0"), ("License: ISC", "ISC"), ("It is distributed under the terms of the AGPLv3.", "AGPL-3.0-only"),
    ("This is not licensed under the MIT license.", ""), ("We discussed the MIT license and Apache 2.0.", ""), ("SPDX-License-Identifier: Unknown-1.0", ""), ("under the bridge", ""),
)


def test_everyday_lines(spark):
    got = licenses.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EVERYDAY)], "doc_id long, text string")).collect()
    assert {EVERYDAY[r.doc_id][0]: ",".join(r.licenses) for r in got} == dict(EVERYDAY)


def test_slots_and_optional_phrases(spark):
    """Published forms: a holder's name in the third BSD clause, the MIT notice of X11 files, and clauses that nobody knows."""
    google = BSD3.replace("the copyright holder", "Google Inc.")
    x11 = MIT.replace("this permission notice shall", "this permission notice (including the next\nparagraph) shall")
    odd = BSD + "3. No name may ever be used to endorse or promote products made from this\n   software.\n"
    texts = [google, google.replace("of its\n   contributors", "of\n   contributors"), x11, odd, BSD, BSD3]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [["BSD-3-Clause"], ["BSD-3-Clause"], ["MIT"], [], ["BSD-2-Clause"], ["BSD-3-Clause"]]


def test_everyday_lines_and_their_sql(spark, tmp_path):
    google = BSD3.replace("the copyright holder", "Google Inc.")
    texts = [t for t, _ in EVERYDAY] + [google, BSD + "No name may endorse or promote products.", MIT.replace("notice shall", "notice (including the next\nparagraph) shall"), "\n".join(t for t, _ in EVERYDAY)]
    got, want = on_odd(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, licenses, ["doc_id", "n_sentences", "sentence_ids", "licenses"])
    assert rows_of(got) == rows_of(want)


def check_packing(pieces, rows, tokens):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in rows:
        ids = [*tokens(text or ""), 0]
        own = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1]) and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == list(np.cumsum([0] + [p.length for p in seq])[:-1]) and sum(p.length for p in seq) <= packing.CAPACITY


def test_packing_round_trip(odd, odd_rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packing.packed(odd).collect(), odd_rows, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert packing.packed(empty).count() == 0


def test_ids_are_those_of_the_tokenizers_file(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["  a\t\n b 's x’s １２ \U0001f600 ñ\u0301\x00", "it's  \n\n done "]
    assert [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)] == [enc.encode_ordinary(t) for t in texts]


def test_added_tokens_inside_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one  <|endoftext|>  two\n\n<|endoftext|><|endoftext|>\n it's", "<|endoftext|", "<|ENDOFTEXT|> x", "word <|endoftext|>" * 700]
    rows = list(enumerate(texts))
    check_packing(packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, lambda t: tok.encode(t, add_special_tokens=False).ids)


def test_packing_query_has_the_ids_of_the_tokenizers_file(spark, data):
    """Every piece of the whole table, through the registered query."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_packing(QUERIES["op3_packing"](spark, data).collect(), rows, lambda t: tok.encode(t, add_special_tokens=False).ids)


def test_differencing_is_near_equal():
    """Windows hold every piece once, none is too full, and their number rises only as far as it must."""
    rng = np.random.default_rng(2)
    for low, high, n in ((1, 257, 1), (1, 257, 3), (1, 257, 512), (1, 513, 50), (1, 513, 512), (500, 1025, 512), (1024, 1025, 7)):
        sizes = rng.integers(low, high, n).tolist()
        w = packing.windows(sizes)
        loads = [sum(sizes[i] for i in x) for x in w]
        assert sorted(i for x in w for i in x) == list(range(n)) and max(loads) <= packing.CAPACITY
        least = -(-sum(sizes) // packing.CAPACITY)
        if n == 512 and high <= 513:
            assert len(w) <= 1.015 * least + 1 and max(loads) - min(loads) < 200
    assert packing.windows([]) == []
    with pytest.raises(ValueError):
        packing.windows([2000])


def test_the_number_of_windows_rises_when_they_are_too_full():
    """Three pieces of 600 can't share two windows, though their sum could."""
    assert sorted(map(len, packing.windows([600, 600, 600]))) == [1, 1, 1]
    rng = np.random.default_rng(5)
    rose = 0
    for _ in range(10):
        sizes = rng.integers(1, 513, 512).tolist()
        least = -(-sum(sizes) // packing.CAPACITY)
        k = len(packing.windows(sizes))
        assert packing.differenced(np.array(sizes), k)[0][0] <= packing.CAPACITY < packing.differenced(np.array(sizes), k - 1)[0][0] or k == least
        rose += k > least
    assert rose


def test_padding_is_little(spark, data):
    p = packing.packed(spark.read.parquet(f"{data}/documents.parquet").coalesce(1))
    n, s = p.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert n / (s * packing.CAPACITY) > 0.99


def test_toxicity_held_out(spark):
    import random

    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic, low = int(i % 9 == 0), int(i % 7 == 0)
        words = [rng.choice(plain) for _ in range(60)] + toxic * rng.sample(["vile", "scum", "rot"], 2) + low * ["###"] + low * ["zzjunk"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - low, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fitted(docs, known.where("doc_id < 600"))
    assert chain.names == ["low_quality", "toxic"] and [len(w) for w in chain.weights] == [1 + len(chain.words), 2 + len(chain.words)]
    got = chain.scored(docs.where("doc_id >= 600")).join(known, "doc_id").collect()
    low, high = chain.thresholds
    assert all((r.p_toxic >= high) == bool(r.toxic) for r in got)
    assert all((r.p_low_quality >= low) == (r.quality == 0) for r in got)


def test_logistic_is_the_least_loss():
    """Against long plain gradient descent on the same loss."""
    rng = np.random.default_rng(0)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1] - 0.5)))).astype(float)
    got, w, b = toxicity.logistic(x, y, 0.01), np.zeros(4), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - 0.5 * (x.T @ (p - y) / 300 + 0.01 * w), b - 0.5 * (p - y).mean()
    assert np.allclose(got, [b, *w], atol=1e-4)
    assert toxicity.logistic(x, np.ones(300))[0] > 20 and toxicity.logistic(x, np.zeros(300))[0] < -20


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = (rng.random((240, 5)) < 0.5).astype(float)
    y = np.c_[x[:, 0] * (rng.random(240) < 0.8), x[:, 1] * (rng.random(240) < 0.8)].astype(float)
    fold, own = np.arange(240) % 3, [np.array([0, 1, 2]), np.array([0, 1, 3]), np.array([1, 4]), np.arange(5)]
    weights, out = toxicity.chained(x, y, fold, own)
    sure = lambda z: 1 / (1 + np.exp(-z))
    for f in range(3):
        rest = fold != f
        w = toxicity.logistic(x[rest][:, own[f]], y[rest, 0])
        assert np.allclose(out[~rest, 0], sure(w[0] + x[~rest][:, own[f]] @ w[1:]))
        w = toxicity.logistic(np.c_[x[rest][:, own[f]], out[rest, 0]], y[rest, 1])
        assert np.allclose(out[~rest, 1], sure(w[0] + np.c_[x[~rest][:, own[f]], out[~rest, 0]] @ w[1:]))
    last = toxicity.logistic(np.c_[x, out[:, 0]], y[:, 1])
    assert np.allclose(weights[1], last) and len(weights[0]) == 6
    chain = toxicity.Chain(["a", "b"], {c: i for i, c in enumerate("vwxyz")}, weights)
    first = sure(weights[0][0] + weights[0][1] + weights[0][3])
    assert np.allclose(chain.probabilities({"v", "x", "other"}), [first, sure(last[0] + last[1] + last[3] + last[6] * first)])


def test_threshold_of_best_f1():
    rng = np.random.default_rng(3)
    for _ in range(50):
        y = (rng.random(30) < 0.3).astype(float)
        p = np.round(np.clip(0.4 * y + 0.6 * rng.random(30), 0, 1), 1)
        f1 = lambda t: 2 * (y * (p >= t)).sum() / ((p >= t).sum() + y.sum())
        if 0 < y.sum() < 30:
            assert f1(toxicity.best_threshold(p, y)) == pytest.approx(max(f1(t) for t in np.arange(0.0, 1.01, 0.05) + 1e-9))


def test_toxicity_query_is_its_chain_and_holds_out(spark, data):
    """Every score of the registered query is the fitted chain's; labels that the fit didn't see are mostly met."""
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.fitted(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, data).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert np.allclose([got[d].p_low_quality, got[d].p_toxic], chain.probabilities(toxicity.words_of(t))) and got[d].toxic == (got[d].p_toxic >= chain.thresholds[1])
    part = toxicity.fitted(docs, labels.where("doc_id % 4 <> 0"))
    seen = part.scored(docs).join(labels.where("doc_id % 4 = 0 and toxic is not null"), "doc_id").collect()
    assert len(seen) > 10 and sum((r.p_toxic >= part.thresholds[1]) == (r.toxic == 1) for r in seen) / len(seen) > 0.9


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(100, 1, 0), (101, None, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fitted(odd, labels).scored(odd).count() == odd.count()
    shared = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "g")], "doc_id long, text string")
    assert toxicity.fitted(shared, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).scored(shared).count() == 3
    none = toxicity.fitted(odd, labels.limit(0))
    assert none.scored(odd).where("p_toxic > 0.01").count() == 0 and none.scored(empty).count() == 0
