import collections
import math
import zlib
from hashlib import md5

import pytest
from compare import differences
from helpers import documents, frame

from tickerloom.llm import op10_sharding as s


def plain(key, weights):
    bid = lambda i: -math.log((int(md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[i]
    return min((i for i in range(len(weights)) if weights[i]), key=bid)


def test_matches_brute_force(spark, sf):
    docs = documents(sf)
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    rows = s.op10_rendezvous_sharding(spark, sf).collect()
    assert len(rows) == len(docs)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain(r.doc_id, [1] * 40), plain(r.doc_id, [1] * 41))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_matches_sql(spark, sf, con):
    got = s.op10_rendezvous_sharding(spark, sf).select("doc_id", "size", "law", "shard", "slot", "grown_shard", "text_crc32")
    assert differences(got.toPandas(), s.ORACLE_SQL, con) == ""


def test_weights_share_records(spark):
    df = spark.range(20_000)
    got = {r.shard: r["count"] for r in s.shard_records(df, "id", [1, 2, 0, 3]).groupBy("shard").count().collect()}
    assert set(got) == {0, 1, 3} and abs(got[3] / 20_000 - 0.5) < 0.02 and abs(got[0] / 20_000 - 1 / 6) < 0.02
    with pytest.raises(ValueError):
        s.shard_records(df, "id", [0.0])


def test_growing_moves_few_and_only_to_the_new(spark):
    df = s.shard_records(spark.range(20_000), "id", [1.0] * 10, [1.0] * 11)
    moved = df.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 10").count() == 0 and abs(moved.count() / 20_000 - 1 / 11) < 0.01


def test_awkward_rows(spark):
    got = s.with_slots(s.shard_records(frame(spark), "doc_id", [1.0] * 4), "shard", ["doc_id", "text"], slices=3).collect()
    assert len(got) == 10
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert next(r.shard for r in got if r.doc_id is None) == plain("null", [1] * 4)
    assert s.with_slots(s.shard_records(frame(spark).limit(0), "doc_id", [1.0]), "shard", ["doc_id"]).count() == 0
