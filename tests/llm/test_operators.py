"""The ten operators against plain implementations and on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from datumgate.llm import bpe, decontaminate, language_id, licenses, line_dedup, ngram_join, quality_rules, secrets, url_filter, warc
from datumgate.llm.oracles import llm_oracles
from datumgate.llm.queries import llm_queries
from datumgate.plans.tables import table

from ..compare import connect, difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, key long"
LONG = " ".join(f"word{i}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "s1", 0, 0.5, "x", 1),
    (2, "", "en", None, 0, None, None, None),
    (3, " \n\t ", None, "s1", 4, 1.0, "x", 2),
    (4, "One line only.", "en", "s1", 14, 1.0, "y", 3),
    (4, "One line only.", "en", "s1", 14, 1.0, "y", 3),
    (None, "A text without an id.", None, "s2", 21, 1.0, "z", 4),
    (5, LONG, "en", "s3", len(LONG), 1.0, "z", 5),
    (6, "12345 --- 678", "en", "s3", 13, 1.0, "z", 6),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return table(spark, sf_small, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, sf_check, name):
    assert difference(llm_queries()[name](spark, sf_check), connect(sf_check), llm_oracles()[name]) is None


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# 1


def test_line_dedup_awkward(awkward, nothing):
    out = line_dedup.dedup_lines(awkward, min_sites=1)
    rows = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert Counter(rows) == Counter((r[0], r[1], int(bool((r[1] or "").strip())), 0) for r in AWKWARD)
    assert out.columns[:8] == awkward.columns
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(i, f"own line {i}\nshared line", f"s{i}", i, -i, "d", "l", "h") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _ROW long, _drop string, _lines string, _hash string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    for r in out.collect():
        assert (r._id, r._ROW, r._drop, r._lines, r._hash) == (r.doc_id, -r.doc_id, "d", "l", "h")
        assert r.n_removed == (r.doc_id > 0) and ("shared" in r.text) == (r.doc_id == 0)


def test_line_dedup_near_the_threshold(spark):
    rows = [(i, f"Shared by eight.\nOwn {i}.", f"s{i % 8}") for i in range(40)]
    rows += [(100 + i, f"Shared by seven.\nOwn {i + 100}.", f"s{i % 7}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, min_sites=8).collect()}
    assert out[0] == "Shared by eight.\nOwn 0."
    assert all(out[i] == f"Own {i}." for i in range(1, 40))
    assert all(out[100 + i].startswith("Shared by seven.") for i in range(40))


# 2


def test_language_on_held_out_rows(spark, sf_check):
    langs = {r.doc_id: r.lang for r in table(spark, sf_check, "documents").collect()}
    held_out = [r for r in llm_queries()["op2_language_id"](spark, sf_check).collect() if r.held_out]
    right = sum(r.lang_pred == langs[r.doc_id] for r in held_out)
    assert right >= 0.97 * len(held_out)


def test_language_awkward(awkward, nothing, docs):
    model = language_id.train(docs)
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(awkward, model).collect()]
    assert [p for d, p in got if d in (1, 2, 3, 6)] == ["und"] * 4
    assert all(p in model.languages for d, p in got if d in (4, 5, None))
    assert language_id.identify(awkward, model).columns == [c for c in awkward.columns if c != "score"] + ["lang_pred", "score"]
    assert language_id.identify(nothing, model).count() == 0
    untrained = language_id.train(nothing)
    assert {r.lang_pred for r in language_id.identify(awkward, untrained).collect()} == {"und"}


def test_language_keeps_columns_of_any_name(docs):
    model = language_id.train(docs)
    renamed = docs.withColumns({"LANG_PRED": F.lit("x"), "Score": F.lit("y"), "_text": F.lit("z")}).limit(20)
    found = language_id.identify(renamed, model)
    assert found.columns == [*docs.columns, "_text", "lang_pred", "score"]
    assert all(r.lang_pred != "x" and 0 <= r.score <= 1 and r._text == "z" for r in found.collect())


def test_sliced_filter_returns_all_languages_of_a_gram(docs):
    model = language_id.train(docs, min_share=0.0)
    grams = dict(language_id._grams(np.frombuffer(b" de ", np.uint8)))[4]
    masks = [model.slices[p] for p in language_id._positions(grams)]
    found = {lang for k, lang in enumerate(model.languages) if all((m >> k) & 1 for m in masks)}
    assert {"es", "fr"} <= found


def test_shared_grams_tell_related_languages_from_the_rest(spark, docs):
    model = language_id.train(docs)
    gram = dict(language_id._grams(np.frombuffer(b" de ", np.uint8)))[4]
    masks = [model.slices[p] for p in language_id._positions(gram)]
    assert {"es", "fr"} <= {lang for k, lang in enumerate(model.languages) if all((m >> k) & 1 for m in masks)}
    rows = [(i, text, lang) for i in range(20) for lang, text in (("a", "xyz wvu"), ("m", "nacht und tag"), ("n", "nacht und dag"))]
    related = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "nacht"), (2, "nacht und tag"), (3, "nacht und dag")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, related).collect()}
    assert got[1][0] in ("m", "n") and 0.4 < got[1][1] <= 0.51
    assert got[2][0] == "m" and got[3][0] == "n"


# 3


def plain_links(rows, threshold=0.8):
    sets = []
    for text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and common >= threshold * (len(a) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return links, [root(i) for i in range(len(rows))]


def variants(count):
    """Near copies of one text, of varying distance, and texts of their own."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for k in range(count):
        own = list(base)
        for j in range(k % 4):
            own[(13 * k + 29 * j) % 60] = f"x{k}{j}"
        out.append(" ".join(own))
    return out + [" ".join(f"y{k}{i}" for i in range(30)) for k in range(20)] + ["a b", "A, b!", "a b c", None, ""]


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CONTENTS", 8)
    rows = variants(60)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    links, roots = plain_links(rows)
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.ngram_join(frame).collect()}
    assert got == {i: (links[i], roots[i]) for i in range(len(rows))}


def test_join_on_documents(docs, texts):
    ids = sorted(texts)
    links, roots = plain_links([texts[i] for i in ids])
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {d: (links[k], ids[roots[k]]) for k, d in enumerate(ids)}


def test_rows_sent_grow_with_the_contents(spark):
    """One group of near copies: a content goes to the same number of tasks, however many there are."""
    sent = []
    for n in (2000, 4000, 8000, 16_000):
        members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("content"), F.lit(0).cast("long").alias("leader"))
        reps = spark.range(n).select(F.col("id").alias("content"), F.lit(150).alias("n_shingles"))
        blocks = ngram_join.blocks_of(members, reps).cache()
        pairs = ngram_join.block_pairs(members, blocks)
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
        sent.append(sides.join(blocks, "block").count())
    assert sent == [8 * n for n in (2000, 4000, 8000, 16_000)]


def test_homes_reach_over_buckets(spark):
    chain = [(b, c) for b in range(6) for c in (b, b + 1)]
    members = spark.createDataFrame([(b, c, min(x for k, x in chain if k == b)) for b, c in chain], "bucket long, content long, leader long")
    homes = {r.content: r.home for r in ngram_join.homes_of(members).collect()}
    assert homes == {c: max(0, c - 1 - ngram_join.HOME_ROUNDS) for c in range(7)}


def test_tiles_hold_every_pair_once(monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    for n, m in ((0, 0), (1, 5), (9, 7), (8, 4)):
        a, b = np.arange(n), np.arange(100, 100 + m)
        within = [(own[i], own[j]) for own, left, right in ngram_join._tiles(a, None) for i, j in zip(left, right, strict=True)]
        assert Counter(within) == Counter((i, j) for i in range(n) for j in range(i + 1, n))
        across = [(own[i], own[j]) for own, left, right in ngram_join._tiles(a, b) for i, j in zip(left, right, strict=True)]
        assert Counter(across) == Counter((i, j) for i in a for j in b)


def test_one_per_class_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (3, "g h i j k l", 3, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash string")
    kept = ngram_join.one_per_class(frame, ngram_join.ngram_join(frame))
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]] and kept.columns == frame.columns


def test_join_awkward(awkward, nothing):
    joined = ngram_join.ngram_join(awkward)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in joined.collect())
    assert got[4, 4, 1] == 2 and got[None, None, 0] == 1 and got[1, 1, 0] == 1
    kept = ngram_join.one_per_class(awkward, joined)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6])
    assert ngram_join.ngram_join(nothing).count() == 0


def test_fewest_matches_keep_the_posterior():
    needed = ngram_join.fewest_matches(0.8, 1e-6)
    assert needed[16] < needed[64] < needed[128] < 0.8 * 128
    assert all(a <= b for a, b in zip(needed, needed[1:], strict=False))


# 4


def test_bpe_equals_the_library(awkward, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = ["<|endoftext|> and <|endoftext|>", "     x\x1c\x1dy", "日本語 😀 it's we'll", "x" * 5000]
    frame = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).collect()
    spark = docs.sparkSession
    rows = [(r.doc_id, r.text) for r in frame] + [(-k - 1, t) for k, t in enumerate(extra)]
    encoded = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), path, decode=True)
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in encoded.collect())
    assert got == want
    again = bpe.decode_texts(encoded, path)
    assert Counter((r.doc_id, r.decoded) for r in again.collect()) == Counter((d, x) for (d, _, x), n in want.items() for _ in range(n))
    assert bpe.encode_texts(nothing, path).count() == 0


# 5

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark, tmp_path):
    same = "é" * 80
    rows = [(3, "http://a/", same, "q"), (1, "http://b/\r\nX: y", same, None), (2, None, "short", "q"), (4, "u", "short", "q")]
    rows += [(5, "u", None, "q"), (None, "u", same, "q"), (6, "u", LONG, "q")]
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.archived_pages(spark, str(tmp_path / "w")).collect()}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {3: 1, None: 1}
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("record_type = 'revisit'").count() == 2
    warc.write_warc(warc.page_records(pages.limit(0)), str(tmp_path / "none"))
    assert warc.archived_pages(spark, str(tmp_path / "none")).count() == 0


def test_warc_identifiers_of_any_text(spark, tmp_path):
    same = "x" * 200
    ids = ["p1", "p2", "a b/%41\n+ü", "", None]
    pages = spark.createDataFrame([(i, "http://x.org/", same) for i in ids], "page_id string, url string, html string")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "texts"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(spark, str(tmp_path / "texts"), "string").collect()}
    assert got == {i: ("response", None) if i == "" else ("revisit", "") for i in ids}


def test_warc_queries_of_one_frame_do_not_share_filters(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://{k % 3}/", "x" * 200 if k % 2 else f"y{k}", None) for k in range(20)], PAGES)
    warc.write_warc(warc.page_records(pages), str(tmp_path))
    records = warc.read_warc(spark, str(tmp_path))
    kinds = [records.where(F.col("record_type") == kind) for kind in (warc.RESPONSE, warc.REVISIT)]
    assert [k.count() for k in kinds] == [11, 9] and records.count() == 20
    assert kinds[0].unionByName(kinds[1]).count() == 20
    chosen = warc.read_warc(spark, str(tmp_path), among={"record_type": [warc.RESPONSE]}, starting={"target_uri": "http://0"})
    expected = records.where("record_type = 'response' and target_uri like 'http://0%'")
    assert sorted(r.record_id for r in chosen.collect()) == sorted(r.record_id for r in expected.collect())
    with pytest.raises(Exception, match="not columns of the record header"):
        warc.read_warc(spark, str(tmp_path), among={"payload": ["x"]}).count()


def test_unwanted_payloads_are_not_inflated(tmp_path, monkeypatch):
    row = dict.fromkeys(warc.HEADER_COLUMNS) | {"record_type": "response", "payload": b"z" * 100_000, "payload_bytes": 100_000}
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(warc.record_bytes(row)) * 3)
    reader, inflated = warc.WarcReader({"path": str(tmp_path)}), []
    plain = warc._Member._inflate
    monkeypatch.setattr(warc._Member, "_inflate", lambda self, limit: inflated.append(limit) or plain(self, limit))
    reader.filters.append(("record_type", "in", {"revisit"}))
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]
    assert max(inflated) <= 2048
    reader.filters.clear()
    assert [len(r[-1]) for p in reader.partitions() for r in reader.read(p)] == [100_000] * 3


def test_plain_and_foreign_archives(tmp_path):
    import gzip

    row = dict.fromkeys(warc.HEADER_COLUMNS) | {"record_type": "response", "payload": b"hello", "payload_bytes": 5}
    record = warc.record_bytes(row)
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] == [b"hello"] * 4


# 6


def test_license_base_counts(docs, texts, awkward, nothing):
    for r in licenses.scan_licenses(docs).collect():
        w = words(texts[r.doc_id])
        places = sorted(
            (i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()
        )
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD)
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Redistribtion and use in sorce and binary forms", "bsd"),
        ("permision is hereby granted, free of chargee", "mit"),
        ("Creatve Commons Atribution", "cc-by"),
        ("GNU Genral Public Licens", "gpl"),
    ],
)
def test_edited_notices(text, label):
    found = licenses.scan_text("aaa " + text + " zzz", licenses.Scanner())
    span = next(s for s in found["spans"] if s["label"] == label)
    assert span["edits"] > 0 and span["start_word"] == 1 and 0 < found["score"] < 1


def test_many_edited_notices_in_one_text():
    found = licenses.scan_text("gnu general public licence " * 20_000, licenses.Scanner())
    assert [s["start_word"] for s in found["spans"]] == list(range(0, 80_000, 4))


# 7


def test_quality_awkward(awkward, nothing):
    got = {r.doc_id: r for r in quality_rules.judge_documents(awkward).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 30_000 and not got[5].base_failed and not got[5].kept
    assert quality_rules.judge_documents(nothing).count() == 0


def test_repeated_windows(spark):
    rows = [("a b c a b c a b c", 9), ("a b c d", 0), ("a a a", 0), ("a a a a", 4), ("x a b c y a b c z", 6), ("", 0), ("a b", 0)]
    frame = spark.createDataFrame(rows, "text string, n int")
    got = frame.select("n", quality_rules.words_in_repeated_windows(quality_rules.words_of(F.col("text"))).alias("m"))
    assert all(r.n == r.m for r in got.collect())


def test_navigation_costs_the_document(spark):
    menu = "\n".join(["Home | News | Sport | About"] * 30 + ["One honest sentence stands here."])
    prose = "\n".join(f"One{i} clean{i} sentence{i} follows{i} another{i}." for i in range(20))
    frame = spark.createDataFrame([(1, menu), (2, prose)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.judge_documents(frame).collect()} == {1: False, 2: True}


def test_long_lines_are_judged_in_linear_time(spark):
    lines = ["|" * 50_000 + ".", "click here" + " " * 50_000 + ". x", "a | b | c", "a | b | c.", "read more", "Read more now! "]
    fails = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in fails.select(quality_rules.line_fails(F.col("line"), quality_rules.LineRules())).collect()]
    assert got == [False, False, True, False, True, True]


# 8


def test_leaks(spark):
    item = [f"q{i}" for i in range(30)]
    edited = [w if i % 7 else f"e{i}" for i, w in enumerate(item)]
    frame = spark.createDataFrame(
        [(1, "pre " * 20 + " ".join(item) + " post" * 20), (2, "pre " * 9 + " ".join(edited)), (3, "pre " * 50), (4, None), (5, "")]
        + [(6, " ".join(item[:5]) + " other words follow"), (1, " ".join(item))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame, items).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].score == 1.0 and (got[2, 7].start_word, got[2, 7].end_word) == (10, 39)
    assert {r.doc_id for r in decontaminate.without_leaks(frame, items).collect()} == {3, 4, 5, 6}
    # Other texts under a leaking id, null or not, stay.
    leak = next(r for r in frame.collect() if r.doc_id == 1)
    rows = [(1, leak.text, "a", 1), (1, "a clean text", "b", 2), (None, leak.text, "c", 3), (None, "also clean", "d", 4), (None, None, "e", 5)]
    shared = spark.createDataFrame(rows, "doc_id long, text string, key string, row int")
    left = decontaminate.without_leaks(shared, items)
    assert left.columns == shared.columns and sorted(r.key for r in left.collect()) == ["b", "d", "e"]
    assert decontaminate.find_leaks(frame.limit(0), items).count() == 0
    assert decontaminate.find_leaks(frame, items.limit(0)).count() == 0


@pytest.mark.parametrize("every", [3, 4])
def test_leaks_with_many_edits(spark, every):
    items = [[f"q{k}x{i}" for i in range(n)] for k, n in enumerate((11, 14, 20, 35, 60))]
    rows = []
    for k, item in enumerate(items):
        replaced = [f"e{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
        lost = [w for i, w in enumerate(item) if i % every != every - 1]
        added = [x for i, w in enumerate(item) for x in ([w, f"e{i}"] if i % 2 else [w])]
        rows += [(10 * k + j, f"some words before {' '.join(copy)} and some after") for j, copy in enumerate((replaced, lost, added))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    want = set()
    for d, text in rows:
        for k, item in enumerate(items):
            number = {w: i for i, w in enumerate(dict.fromkeys([*item, *text.split()]))}
            best, _ = decontaminate.align(*(np.array([number[w] for w in side]) for side in (item, text.split())))
            want |= {(d, k)} if best >= len(item) else set()
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, tests).collect()}
    assert got == want and len(want) >= 10


def test_leaks_of_documents(docs, texts, spark, sf_small):
    items = {r.item_id: words(r.text) for r in table(spark, sf_small, "benchmark").collect()}
    want = set()
    for d, text in texts.items():
        padded = " " + " ".join(words(text)) + " "
        want |= {(d, i) for i, w in items.items() if len(w) >= 4 and " " + " ".join(w) + " " in padded}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table(spark, sf_small, "benchmark")).collect()}
    assert want <= got


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


# 9


def test_secret_base_spans(docs, texts, awkward, nothing):
    for r in secrets.scan_secrets(docs).collect():
        text, want = texts[r.doc_id] or "", []
        for m in re.finditer(r"[0-9a-f]+", text):
            want += [("hex", *m.span())] if len(m[0]) >= 16 else []
        for m in re.finditer(r"AKIA[A-Z0-9]+", text):
            want += [("access", *m.span())] if len(m[0]) >= 18 else []
        base = [tuple(s) for s in r.base_spans]
        assert sorted(s for s in base if s[0] != "assign") == sorted(want)
        assert set(base) <= {tuple(s) for s in r.spans}
    assert secrets.scan_secrets(awkward).count() == len(AWKWARD)
    assert secrets.scan_secrets(nothing).count() == 0


def test_nested_layers():
    import base64
    import gzip
    from urllib.parse import quote

    secret = "password = abcDEF123456xyz"
    layers = [quote(secret, safe=""), base64.b64encode(secret.encode()).decode()]
    layers.append(base64.b64encode(gzip.compress(secret.encode())).decode())
    layers.append(base64.b64encode(quote(layers[1], safe="").encode()).decode())
    layers.append("".join(f"\\u{ord(c):04x}" for c in secret))
    for layer in layers:
        base, spans = secrets.scan_text(f"see {layer} there")
        assert ("assign", 4, 4 + len(layer)) in spans and ("assign", 4, 4 + len(layer)) not in base


def test_whole_layers_are_scanned(monkeypatch):
    import base64
    import gzip
    import random

    secret = "password = abcDEF123456xyz"
    rng = random.Random(1)
    lines = "".join(f"log line about {rng.random()}\n" for _ in range(60))
    wrapped = base64.encodebytes(gzip.compress((lines + secret).encode())).decode().rstrip("\n")
    one = lambda data: base64.b64encode(data).decode()
    layers = ["caf%E9&password%3DabcDEF123456", wrapped, wrapped.replace("\n", "\r\n  ")]
    layers.append(one(bytes(rng.randbytes(300)) + secret.encode() + b"\n" + bytes(rng.randbytes(300))))
    layers.append(one(gzip.compress(b"nothing here") + gzip.compress(secret.encode())))
    layers.append(one(gzip.compress(secret.encode())[:-6]))
    for layer in layers:
        base, spans = secrets.scan_text(f"see {layer} there")
        assert ("assign", 4, 4 + len(layer)) in spans and ("assign", 4, 4 + len(layer)) not in base
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 1000)
    monkeypatch.setattr(secrets, "OVERLAP_BYTES", 100)
    for before in range(900, 2100, 13):
        layer = one(gzip.compress(b"." * before + secret.encode() + b" " + b"." * 1500))
        spans = secrets.scan_text(layer)[1]
        assert {("assign", 0, len(layer)), ("bomb", 0, len(layer))} <= set(spans)


def test_long_runs_and_many_layers():
    import base64

    assert secrets.scan_text("x" * 300_000 + " 5% " + "y" * 300_000 + " \\u") == ([], [])
    tokens = [base64.b64encode(f"token = value{i:012d}".encode()).decode() for i in range(2_000)]
    _, spans = secrets.scan_text(" ".join(tokens))
    assert sum(kind == "assign" for kind, _, _ in spans) == 2_000


def test_assignments_in_either_case():
    base, _ = secrets.scan_text("API_KEY: 'abcdefghijkl' Token=short secret=toolongenough1")
    assert [(k, s) for k, s, _ in base] == [("assign", 0), ("assign", 36)]


# 10


def test_url_filter(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x"),
        (2, "https://a.example.com/en/?q=1"),
        (3, "https://example.com"),
        (4, "x.org/no-scheme"),
        (5, None),
        (6, "http://bad.org/p/?utm_source=a&b=1#f"),
        (7, "http://www.bad.org/p?b=1"),
        (8, "http://bad.org/p?b=2"),
        (8, "http://bad.org/p?b=2"),
        (9, "http://sub.bad.net/es/x/y"),
    ]
    pages = spark.createDataFrame([(*r, "own", 1.0) for r in rows], "page_id long, url string, host string, h double")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    listed = spark.createDataFrame([*rules, ("bad.org", "/p?b=1", "block")], "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, listed)
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert got == {
        1: ("www.example.com/en/", "allow"),
        2: ("example.com/en/", "block"),
        3: (None, "allow"),
        4: (None, "allow"),
        5: (None, "allow"),
        6: (None, "block"),
        7: (None, "block"),
        8: (None, "allow"),
        9: ("net/es/", "block"),
    }
    assert out.count() == len(rows) and set(out.columns) == {"page_id", "url", "h", "host", "path", "rule", "verdict"}
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_listed_urls_may_end_like_rules(spark):
    from datumgate.llm.queries import listed_urls

    rows = [(1, "http://spam.example.net/a?next=http://x.org/"), (2, "http://spam.org/a\nb"), (3, "http://x.org/a"), (4, "http://spam.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed_urls(pages)).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block")}


def listed_under(url, entries):
    """Rule keys a URL fits, by the plain definition, the longest first."""
    host, _, rest = url.partition("://")[2].partition("/")
    path = "/" + re.split("[?#]", rest)[0]
    fits = [h + p for h, p in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return sorted(fits, key=len, reverse=True)


def test_rules_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "ab"[rng.integers(2)] * int(rng.integers(1, 3))
    some = lambda joint, most: joint.join(word() for _ in range(rng.integers(1, most)))
    urls = {f"http://{some('.', 5)}/{some('/', 6)}{'/' if rng.random() < 0.5 else ''}" for _ in range(600)}
    entries = {(some(".", 4), f"/{some('/', 4)}/") for _ in range(60)} | {("b", "/")}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    listed = spark.createDataFrame([(*e, "block") for e in entries], "host string, path string, verdict string")
    wanted = {u: (listed_under(u, entries) or [None])[0] for u in urls}
    # With so small a filter most keys pass it, and the join removes those that are not listed.
    for blocks in (1 << 10, 1):
        monkeypatch.setattr(url_filter, "MIN_BLOCKS", 1)
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
        got = {r.url: r.rule for r in url_filter.judge_urls(pages, listed).collect()}
        assert {u: len(r or "") for u, r in got.items()} == {u: len(r or "") for u, r in wanted.items()}
        assert all(r in listed_under(u, entries) for u, r in got.items() if r)


def test_filter_grows_with_the_list():
    entries = [(f"h{i}.org/", url_filter.RULE) for i in range(20_000)]
    blocks = url_filter.blocks_for(len(entries))
    held = url_filter.entry_hashes(*zip(*entries, strict=True))
    table = np.zeros((blocks, url_filter.WORDS), np.uint64)
    block, masks = url_filter._bits(held, blocks)
    np.bitwise_or.at(table, block, masks)
    assert url_filter.may_hold(table, held).all()
    other = url_filter.entry_hashes([f"other{i}.net" for i in range(50_000)], [url_filter.EXACT] * 50_000)
    assert url_filter.may_hold(table, other).mean() < 0.01
    assert url_filter.blocks_for(10**9) == url_filter.MAX_BLOCKS


def test_long_urls_make_few_keys(spark):
    import tracemalloc

    host, path = ".".join(["a"] * 4_000 + ["com"]), "/x" * 8_000
    tracemalloc.start()
    table = np.zeros((1 << 10, url_filter.WORDS), np.uint64)
    entries = [("com/x/", url_filter.RULE), ("a.com/x/x/x/", url_filter.RULE)]
    block, masks = url_filter._bits(url_filter.entry_hashes(*zip(*entries, strict=True)), len(table))
    np.bitwise_or.at(table, block, masks)
    assert list(url_filter.possible_keys([host], [path], table, 4)) == [(0, k) for k, _ in entries]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    pages = spark.createDataFrame([(1, f"http://{host}{path}", 5)], "page_id long, url string, _rule long")
    listed = spark.createDataFrame([("com", "/x/", "block")], "host string, path string, verdict string")
    [row] = url_filter.judge_urls(pages, listed).collect()
    assert (row.rule, row.verdict, row._rule) == ("com/x/", "block", 5)


def test_long_lists_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 2)
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p") for i in range(50)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.org", "/p", "block") for i in range(0, 50, 2)], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, listed).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(50)}


# Pipeline


def test_pipeline_stages(spark, docs, sf_small, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns, name
        own = awkward.select(*docs.columns)
        assert stage(spark, own, sf_small).count() <= len(AWKWARD), name
        assert stage(spark, nothing.select(*docs.columns), sf_small).count() == 0, name


def test_pipeline_equals_its_parts(spark, docs, texts, sf_small):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf_small).collect()}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, sf_small, "benchmark")).collect()}
    cleaned = line_dedup.without_emptied(line_dedup.dedup_lines(docs, corpus_pipeline.MIN_SITES))
    classes = {r.doc_id: r.class_id for r in ngram_join.ngram_join(cleaned).collect()}
    letters = {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert kept == {d for d, c in classes.items() if d == c and d in letters} - leaks
