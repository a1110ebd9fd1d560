from __future__ import annotations

import re

from rowgauge.llm.licenses import BASE, license_labels, words_of
from rowgauge.llm.queries import QUERIES

from .helpers import SCHEMA, SF, docs, odd_texts, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(text):
    """(n_words, n_base, first_word, last_word, base_labels) by looking at every place."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [
        (k, t.label) for t in BASE for k in range(len(words)) if words[k : k + len(t.words.split())] == t.words.split()
    ]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_registered_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_license_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert base(r) == brute_force(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_odd_texts(spark):
    texts = odd_texts() + [
        "MIT License, mit-license MIT", "GNU General\nPublic License gnu general public license",
        "gnu general public", "cc by cc by cc", "x apache  licenseé apache license", "İ K license cc  BY", "APACHE LICEN\u017fE apache\u00a0license",
        prose(3, 500) + " MIT license " + prose(4, 500) + " Apache License",
    ]
    for r in license_labels(docs(spark, texts)).collect():
        assert base(r) == brute_force(texts[r.doc_id]), texts[r.doc_id][:80]


def test_changed_notices_get_a_label_of_the_method(spark):
    notice = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the Software), to deal in the Software without restriction")
    changed = notice.replace("hereby ", "").replace("free of charge", "wholly free of charge")
    few = "Permission is granted to any person obtaining a copy"
    both = f"{notice} {prose(1)} Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    rows = {r.doc_id: r for r in license_labels(docs(spark, [notice, changed, few, f"{prose(2)} {changed}", both])).collect()}
    assert [rows[k].labels for k in range(5)] == ["mit", "mit", "", "mit", "bsd,mit"]
    assert rows[0].score == 1.0 and 0.7 <= rows[1].score < 1 and rows[2].score == 0
    assert all(rows[k].n_base == 0 and rows[k].base_labels == "" for k in range(5))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = docs(spark, ["mit license", "mit license", "cc by", None, "apache license"], [1, 1, None, None, 1])
    got = license_labels(df.selectExpr("*", "1 AS text_hash", "2 AS words", "3 AS labels", "4 AS pos")).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in got) == [
        ("1", 1, "apache"), ("1", 1, "mit"), ("1", 1, "mit"), ("None", 0, ""), ("None", 1, "cc-by")
    ]


def test_empty_table(spark):
    assert license_labels(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_are_read_once(spark):
    """One scan of the texts, whatever is made of them, and only grams of the templates' words are joined."""
    from rowgauge.llm.licenses import license_hits

    df = docs(spark, ["mit license"]).selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    plan = license_hits(df, BASE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "INSET" in plan.upper() or " IN (" in plan
    assert "Exchange hash" not in plan


def test_words(spark):
    df = spark.createDataFrame([("A-b_c é1 x",)], "t string")
    assert df.select(words_of(df.t)).first()[0] == ["a", "b", "c", "é1 x"]
