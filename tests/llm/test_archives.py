import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import AWKWARD, LONG, awkward, empty, rows
from tests.llm.test_dedup import near_components
from tests.oracle import _rows, connect
from wardflow.llm.common import shared_folder
from wardflow.llm.decontamination import find_leaks
from wardflow.llm.packing import generate_columns, pack, packed_ids, plan_sequences, price_pattern
from wardflow.llm.registered import oracle_sql, queries
from wardflow.llm.warc import base32_sha1, parse_records, read_archive, resolve_revisits, warc_round_trip, with_decision, write_archive

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- archives ---------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, "same"), (4, "http://a/4", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (5, "http://a/5", ""), (6, "http://a/6", None), (7, "http://a/7", "été \x00 日本 " + LONG), (None, "http://a/8", "same"), (None, "http://a/9", "alone"),
    (8, "http://a/8", "twice"), (8, "http://a/8", "twice"),
]


def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, value string, payload_digest string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_of_awkward_pages(spark):
    want = []
    for p, url, html in PAGES:
        best = max((q for q, _, h in PAGES if (h or "") == (html or "") and q is not None), default=None)
        revisit = p != best
        kind = "revisit" if revisit else "response"
        uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
        want.append((p, len((html or "").encode()), digest(html), kind, best if revisit else None, uri))
    assert rows(warc_round_trip(pages(spark))) == sorted(want, key=repr)
    assert warc_round_trip(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc_round_trip(pages(spark), min_bytes=5).filter("payload_bytes < 5")
    assert {r["record_type"] for r in got.collect()} == {"response"} and got.count() == 6


def test_payloads_come_back_and_revisits_resolve(spark):
    path = shared_folder(spark)
    write_archive(with_decision(pages(spark)), path)
    records = resolve_revisits(read_archive(spark, path))
    originals = {r["page_id"]: r["payload"].decode() for r in records.filter("record_type = 'response'").collect()}
    assert originals[7] == PAGES[6][2] and originals[4] == PAGES[3][2]
    for r in records.filter("record_type = 'revisit'").collect():
        assert r["payload"] is None and r["original_id"] == r["refers_to"] and digest(originals[r["original_id"]]) == r["payload_digest"]


def test_archives_are_plain_warc(spark):
    path = shared_folder(spark)
    write_archive(with_decision(pages(spark)).coalesce(1), path)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).first()["content"]
    raw = gzip.decompress(bytes(content))
    found = list(parse_records(io.BytesIO(raw)))
    assert len(found) == len(PAGES) and raw.endswith(b"\r\n\r\n") and raw.startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert all({"warc-record-id", "warc-date", "content-length", "warc-type"} <= set(h) for h, _ in found)


def test_damaged_records_are_found(spark):
    decided = with_decision(pages(spark)).withColumn("html", F.concat("html", F.lit("!")))
    path = shared_folder(spark)
    write_archive(decided, path)
    assert read_archive(spark, path).filter("NOT intact").count() > 0


def test_digest_in_built_in_functions(spark):
    texts = ["", "a", "été", "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [digest(t) for t in texts]


# --- packing ----------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizers(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ["", "It's  we'll \n\n x²½ 3a", "<|endoftext|>x", "  ", "a  \t b\x1c c\x85d\xa0e", "日本 test", "'S 'llama ''s", "ß ªº× ÷ Ð", LONG[:3000]]
    texts += [t for _, t, *_ in AWKWARD if t]
    for text, packed in zip(texts, packed_ids(texts, VOCABULARY)):
        assert np.frombuffer(packed, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def check_packing(result, docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {}
    for d, t in docs:
        ids.setdefault(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, places = {}, {}
    for r in result.collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, found in pieces.items():
        copies = sum(x == d for x, _ in docs)
        assert sorted(found) == sorted([(s, min(2048, len(ids[d]) - s)) for s in range(0, len(ids[d]), 2048)] * copies)
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    assert set(pieces) == set(ids)
    return places


def test_packing_of_awkward_rows(spark):
    known = [(d, t) for d, t, *_ in AWKWARD if d is not None]
    check_packing(pack(awkward(spark).filter("doc_id IS NOT NULL"), VOCABULARY), known)
    check_packing(pack(spark.createDataFrame([(None, "no id"), (1, "id")], "doc_id long, text string"), VOCABULARY), [(None, "no id"), (1, "id")])
    assert pack(empty(spark), VOCABULARY).count() == 0


def test_packing_leaves_little_padding(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = pack(documents, VOCABULARY)
    places = check_packing(result, [(r["doc_id"], r["text"]) for r in documents.collect()])
    tokens = sum(n for p in places.values() for _, n in p)
    assert len(places) * 2048 < 1.02 * tokens


def test_knapsack_equals_trying_everything():
    sizes, values = np.array([2, 3, 5]), np.array([0.3, 0.55, 0.8])
    best = max(a * 0.3 + b * 0.55 + c * 0.8 for a in range(7) for b in range(5) for c in range(3) if 2 * a + 3 * b + 5 * c <= 13)
    worth, pattern = price_pattern(values, sizes, 13)
    assert worth == pytest.approx(best) and pattern @ sizes <= 13 and pattern @ values == pytest.approx(best)


def test_columns_reach_the_optimum_of_a_known_program():
    # Pieces of 3, 5 and 7 in lengths of 16: the optimum of the linear program is 38.75 (known from enumeration of patterns).
    sizes, demand = np.array([3, 5, 7]), np.array([25.0, 20.0, 18.0])
    patterns, amounts = generate_columns(sizes, demand, 16, gap=0)
    every = [(a, b, c) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16]
    assert (patterns @ sizes <= 16).all() and np.allclose(amounts @ patterns, demand)
    prices = np.linalg.solve(patterns.astype(float), np.ones(3))
    assert max(np.dot(p, prices) for p in every) <= 1 + 1e-9  # no pattern could improve it


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 30, 64)
    plan = plan_sequences(np.arange(1, 65), demand, 64)
    room = np.zeros(plan.sequences, int)
    for c, (ends, each, base) in enumerate(zip(plan.ends, plan.each, plan.base)):
        assert (ends[-1] if len(ends) else 0) == demand[c]
        for lo, hi, n, b in zip(np.append(0, ends[:-1]), ends, each, base):
            for k in range(hi - lo):
                room[b + k // n] += c + 1
    assert room.max() <= 64 and plan.sequences <= np.dot(demand, np.arange(1, 65)) / 64 * 1.05 + 4


# --- registered queries and the pipeline ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    got = queries()[name](spark, SF)
    want = connect(SF).sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_one_query_for_each_operator_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    import __spark_entry__ as contract

    assert {*queries(), "pipeline"} <= set(contract.queries())


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, "12 34 !!", "en", "s", 8), (10_002, None, None, None, None)], docs.schema)
    texts = {}
    stages = dict(corpus_pipeline.STAGES)
    start = docs.union(odd)
    identified = stages["language_id"](spark, start, SF)
    assert identified.columns == docs.columns and {10_001, 10_002}.isdisjoint(r["doc_id"] for r in identified.collect()) and identified.count() == docs.count()
    single = stages["exact_dedup"](spark, identified.union(identified.limit(3)), SF)
    for r in identified.collect():
        key = r["text"].encode().lower()
        texts[key] = max(r["doc_id"], texts.get(key, -1))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(texts.values())
    unlike = stages["simhash_near_dedup"](spark, single, SF)
    linked = near_components([(r["doc_id"], r["text"].encode()) for r in single.collect()])
    assert {r["doc_id"] for r in unlike.collect()} == set(linked.values()) and len(set(linked.values())) < len(linked)
    clean = stages["benchmark_decontamination"](spark, unlike, SF)
    leaks = {r["doc_id"] for r in find_leaks(unlike, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unlike.collect()} - leaks and clean.columns == docs.columns
    packed = stages["packing"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}
