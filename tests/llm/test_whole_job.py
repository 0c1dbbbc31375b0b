"""Rows that repeat an id or have none, and texts over several lines or blocks."""

import base64
import hashlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linelake.llm import decontaminate, license, warc
from linelake.llm.oracle import ORACLE
from tests.compare import same


def test_decontamination_keeps_rows_whatever_the_benchmarks_size(spark):
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words[:20]), " ".join(words[30:50])
    rows = [(1, "x " + first), (1, "x " + first), (1, second), (2, "y " * 30), (None, first + " z"), (None, second), (None, None), (None, "q " + second + " " + first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(words[at : at + 14])) for i, at in enumerate((0, 4, 30, 33))], "item_id long, text string")
    plain = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans)), r.longest, r.longest_item, r.longest_at) for r in df.collect())
    one, several = (plain(decontaminate.find_matches(docs, bench, block_bytes=n)) for n in (1 << 20, 100))
    assert sum(several.values()) == len(rows)
    assert several == one
    assert one[1, 21, 18, ("0", "1"), ((1, 19),), 14, "0", 1] == 2
    left = decontaminate.decontaminate(docs, bench)
    assert Counter((x.doc_id, x.text) for x in left.collect()) == Counter(x for x in rows if x[1] is None or x[1].startswith("y"))


def test_search_grows_with_the_words_and_the_places(spark):
    import random
    import time

    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    own = [" ".join(r.choices(words, k=400)) for _ in range(30)]
    items = [(f"i{k % 40}", x.encode()) for k, x in enumerate(own)] + [("one", b"w7"), ("again", own[0].encode())]
    texts = [(" ".join(r.choices(words, k=900)) + " " + x).encode() for x in own * 4]
    t = decontaminate.tests(items)
    began = time.perf_counter()
    got = decontaminate.judge(texts, t)
    assert time.perf_counter() - began < 20
    for k, x in enumerate(got):
        assert x[4] == 400 and x[6] == 900 and x[5] == ("again" if k % 30 == 0 else f"i{k % 30}") and x[1] >= 400 and f"i{k % 30}" in x[2]


def test_warc_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, "u", c * 150_000) for i, c in ((7, "a"), (7, "b"), (7, "b"), (None, "c"), (None, "d"), (8, "e"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    chunks = warc.write_archive(df).cache()
    told = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = warc.read_archive(chunks).collect()
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.intact) for x in got) == Counter((i, len(t), told(t), "response", True) for i, _, t in rows)
    warc.export_warc(chunks, f"file://{tmp_path}/a.warc")
    data, found = (tmp_path / "a.warc").read_bytes(), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)[b"Content-Length"])
        found.append(rest[:n].decode())
        data = rest[n + 4 :]
    assert sorted(found) == sorted(t for _, _, t in rows)


def test_warc_revisits_belong_to_the_payload(spark):
    rows = [(5, "u5", "one"), (5, "u5", "two"), (5, "u5", "only here"), (9, "u9", "one"), (11, "u11", "two"), (None, "n", "one"), (5, "u5", ""), (3, None, None), (9, "u9", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for c in ("digest", "size", "refers_to", "part", "keeper"):
        df = df.withColumn(c, F.lit("clash"))
    chunks = warc.write_archive(df).cache()
    told = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {"one": 9, "two": 11, "only here": 5, "": 5}
    want = Counter()
    for i, _, t in rows:
        k = keeper[t or ""]
        want[(i, told(t), "response", None) if i in (None, k) else (i, told(t), "revisit", k)] += 1
    got = warc.read_archive(chunks).collect()
    assert Counter((x.page_id, x.payload_digest, x.record_type, x.refers_to) for x in got) == want and all(x.intact for x in got)
    heads = [bytes(x.data).split(b"\r\n\r\n")[0].decode() for x in chunks.filter("chunk = 0").collect()]
    assert len({h.split("WARC-Record-ID: ")[1].split("\r")[0] for h in heads}) == len(rows)
    assert sum("WARC-Refers-To-Target-URI: u11" in h for h in heads) == 1


def test_warc_writer_never_holds_a_whole_record():
    import tracemalloc
    from itertools import count

    body = ("0123456789abcdef" * 4096) * 1024  # 64 MB
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([1]), pa.array(["u"]), pa.array([hashlib.sha1(body.encode()).hexdigest()]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([body])], list("abcdefg"))
    del body
    tracemalloc.start()
    total, numbers = 0, []
    for part in warc.chunk_rows(batch, count(), warc.CHUNK_BYTES):
        total += part.num_rows
        assert part.nbytes < warc.SLICE_BYTES + 2 * warc.CHUNK_BYTES
        numbers += part.column(3).to_pylist()
    assert total == 1024 and numbers == list(range(1024)) and tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_license_scan_meets_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
    bsd = "x\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that\ny"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    gpl = "a b\nThis program is free software; you can redistribute\nit and/or modify it under the terms of the\nGNU General Public License as published"
    rows = [(1, mit), (1, "other"), (2, bsd), (3, mpl), (4, gpl), (None, mpl), (5, "Released under\n\n\nthe MIT\nLicense"), (6, "Released under the MIT License")]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    labels = {x.doc_id: x.labels for x in got}
    assert labels | {1: ["mit"]} == {1: ["mit"], 2: ["bsd"], 3: ["mpl-2.0"], 4: ["gpl"], None: ["mpl-2.0"], 5: ["mit"], 6: ["mit"]}  # blocks go by words, over any lines
    assert sorted(x.labels for x in got if x.doc_id == 1) == [[], ["mit"]]
    assert {x.doc_id: x.score for x in got if x.doc_id in (2, 3)} == {2: 1.0, 3: 1.0}
    assert [tuple(b) for x in got if x.doc_id == 2 for b in x.blocks] == [(0, 21, "bsd", 1.0)]


def test_license_scan_agrees_with_its_sql_on_any_wrap(spark, tmp_path):
    import random

    r = random.Random(6)
    rows, n = [], 0
    for label, text in license.TEMPLATES:
        w = text.split()
        for lines in (1, 2, 3, 5, 8):
            for noise in (0, 2, len(w)):
                own = list(w)
                for _ in range(noise):
                    own.insert(r.randrange(len(own) + 1), r.choice(["foo", "bar", "#", "x1"]))
                cuts = sorted(r.sample(range(1, len(own)), min(lines - 1, len(own) - 1)))
                parts = [" ".join(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
                rows.append((n, "some words before\n" + "\n// ".join(parts) + " and after", label))
                n += 1
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, "the software of the license, and under to this 2 0 " * 40, "")]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(license.op6_license_scan(spark, str(tmp_path)), con, ORACLE["op6_license_scan"])
    labels = {x.doc_id: x.labels for x in license.scan(docs).collect()}
    assert all(label in labels[i] for i, text, label in rows[: 15 * len(license.TEMPLATES) : 3])  # without noise, in any wrap


def test_frequent_symbols_are_named_alike(spark, monkeypatch):
    import random

    from linelake.llm import recompress

    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, *range(10, 400)]), k) for k in range(3000)]
    places = spark.createDataFrame(rows, "name long, at long")
    seen = {}
    for n, k in rows:
        seen.setdefault(n, []).append(k)
    want = sorted((n, k, min(seen[n])) for n, k in rows if len(seen[n]) > 1)
    for share in (256, 1):
        monkeypatch.setattr(recompress, "SHARE", share)
        assert sorted(tuple(x) for x in recompress._named(places, "name").select("name", "at", "first").collect()) == want


def test_substring_dedup_of_rows_that_share_an_id(spark):
    import random

    from linelake.llm import recompress
    from tests.llm.test_text_operators import repeats_by_force

    r = random.Random(7)
    voc = [f"w{i}" for i in range(400)]
    passage, other = r.choices(voc, k=90), r.choices(voc, k=300)
    run, turns = ["a"] * 70, ["a", "b"] * 40
    texts = [(1, passage + r.choices(voc, k=30)), (2, r.choices(voc, k=5)), (2, r.choices(voc, k=90)), (2, r.choices(voc, k=9) + passage), (3, other), (3, other), (4, other[:200] + ["z"] + other[200:]), (None, passage), (5, run), (6, turns + run), (6, turns), (7, []), (7, passage[10:29]), (7, passage[10:30]), (8, other[5:60] + passage[3:70] + turns)]
    texts += [(20 + i, other + [f"q{i}"]) for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in texts] + [(9, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("_id", "id", "hash", "FOUND", "starts", "_n_words", "part"):
        df = df.withColumn(c, F.lit("clash"))
    order = [x.t for x in df.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("doc_id", "h").select(F.struct("doc_id", "t").alias("t")).collect()]
    gone = repeats_by_force([(k, x.t) for k, x in enumerate(order)], 20)
    want = {(x.doc_id, x.t): " ".join(w for w, g in zip(x.t.split(), gone[k]) if not g) for k, x in enumerate(order)}
    got = recompress.remove_repeats(df, layout=False)
    assert sorted(got.columns) == sorted([*df.columns, "_n_removed"])
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter((i, want.get((i, t or ""), t or "")) for i, t in rows)
    assert any(len(v.split()) < len(t.split()) for (_, t), v in want.items())
    assert recompress.remove_repeats(df, counts=False).columns == df.columns


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op4_substring_dedup", "op5_warc", "op6_license_scan", "op7_benchmark_decontamination"])
def test_queries_agree_with_their_sql(spark, sf, name):
    from linelake.llm.queries import QUERIES
    from tests.compare import duck

    same(QUERIES[name](spark, sf), duck(sf), ORACLE[name])


def test_documents_without_a_partner_leave_their_cells(spark, monkeypatch):
    import numpy as np

    from linelake.llm import jaccard

    keys = lambda *k: np.array(k, np.int64).tobytes()
    rows = [(0, d, 20, 10, 10, keys(1)) for d in range(10)]  # one column in common, nine elsewhere, each alone
    rows += [(100 + d, d, 20, 10, 10, keys(*range(d * 100, d * 100 + 9))) for d in range(2, 10)]
    rows += [(c, d, 20, 2, 4, k) for d in (10, 11) for c, k in ((0, keys(1)), (5, keys(50, 51, 52)))]
    places = spark.createDataFrame(rows, jaccard.PLACES)
    may = jaccard._prune(places, 80).select("cell", "doc_id").distinct()
    want = {(5, 10), (5, 11)}
    assert {tuple(r) for r in may.collect()} == want | {(0, d) for d in range(10)}
    for most in (jaccard.BLOCK, 1):
        monkeypatch.setattr(jaccard, "BLOCK", most)
        assert {tuple(r) for r in jaccard._paired(places, may, 80).collect()} == want


def test_partners_by_force():
    import numpy as np

    from linelake.llm.jaccard import least_shared, partners

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 12))) for _ in range(90)]
    n = np.array([len(s) * 5 for s in sets])
    need = least_shared(n, n, 80)
    ok = np.array([[i != j and len(np.intersect1d(a, b)) >= need[i, j] and min(n[i], n[j]) * 100 >= 80 * max(n[i], n[j]) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert 0 < ok.any(1).sum() < 90 and (partners(sets, [], n, 80) == ok.any(1)).all()
    ok[:50, :50], ok[50:, 50:] = False, False
    assert (partners(sets[:50], sets[50:], n, 80) == ok.any(1)).all()
