import re
import textwrap

from pyspark.sql import functions as F

from lumenweave.llm import license_scan
from tests.llm.test_llm import ODD, odd

NOTICES = ["Copyright (c) 2019-2021 Some Body <a@b.c>\nAll rights reserved.", "(C) 2020 Me", "© Anyone", "Copyright: the holder", "Copyright The Sample Authors", "Copyright [yyyy] [name of copyright owner]", "Copyright Example Inc. 2011", "Copyright Jane Roe", "COPYRIGHT  J. ROE & SONS LTD."]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(rows, license_scan.catalogue(spark)).collect()}


def test_whole_licences_are_found_however_wrapped(spark):
    known = [(i, t) for i, t in license_scan.known_texts() if len(t) > 400]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= {i for i, _ in known}
    texts, want = [], []
    for k, (name, t) in enumerate(known):
        for width in (30, 40, 60, 79, 2000):
            body = NOTICES[k % len(NOTICES)] + "\n\n" + wrapped(t, width)
            texts += [body, "\r\n".join(f" * {line}" for line in body.upper().split("\n")), t + "\nand more"]
            want += [name, name, None]
    got = found(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == want


def test_no_line_of_a_body_is_taken_for_a_holder():
    plain, inner = re.compile(license_scan._PLAIN.replace(r"\z", r"\Z")), re.compile(license_scan.inner_notices())
    for name, text in license_scan.known_texts():
        text = inner.sub(" ", text.lower())
        for width in range(15, 121):
            lines = wrapped(text, width).split("\n")
            assert not [(name, width, x) for x in lines if plain.fullmatch(x)]


def test_spellings_are_one_word_by_word(spark):
    texts = ["Licence licence text", "License license text", "sub-license per cent centre", "sublicense percent center", "the copyright owner", "The  COPYRIGHT holder", "no such thing", "warran-\nty", "warranty"]
    got = found(spark, texts)
    digest = [got[i].digest for i in range(len(texts))]
    assert digest[0] == digest[1] and digest[2] == digest[3] and digest[4] == digest[5] and digest[7] == digest[8]
    assert len(set(digest)) == 5


def test_lines_that_only_begin_like_notices_stay(spark):
    body = ["copyright notice and this permission notice", "(c) You must retain all notices", "copyright treaty adopted on 20 December 1996", "COPYRIGHT HOLDERS AND CONTRIBUTORS"]
    got = found(spark, [f"begin\n{x}\nend" for x in (*body, *NOTICES)])
    plain = found(spark, ["begin end"])[0].digest
    assert [got[i].digest == plain for i in range(len(got))] == [False] * len(body) + [True] * len(NOTICES)


def test_odd_rows_and_other_catalogues(spark):
    docs = odd(spark).withColumn("digest", F.lit("d"))
    got = license_scan.scan(docs, license_scan.catalogue(spark, [("x", "same text, here"), ("y", "nothing")])).collect()
    assert len(got) == len(ODD)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.license_id == "x") == [(False, 1), (False, 1), (False, 7), (True, 0)]
    assert {r.doc_id for r in got if r.digest is None} == {2, 3, 4}
    assert license_scan.scan(docs.limit(0), license_scan.catalogue(spark)).count() == 0

