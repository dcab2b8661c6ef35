import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tracekit.llm import sharding as S

ROWS = ([(i, f"text {i}") for i in range(600)] + [(5, "other text")] + [(9, "text 9")] * 200 + [(None, f"t{i}") for i in range(60)]
        + [(None, None), (700, None), (701, ""), (702, "\u00e9" * 40_000)])


def test_shards_slots_and_growth(docs_of):
    got = S.assign_shards(docs_of(ROWS)).collect()
    assert len(got) == len(ROWS)
    assert (sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
            == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS))
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(x) == 1 for x in by_id.values())
    moved = sum(x != y for (x, y), in by_id.values())
    assert 0 < moved < len(by_id) / 10
    grown = {r["doc_id"]: r["shard"] for r in S.assign_shards(docs_of(ROWS), 25).collect()}
    assert all(grown[i] == y for i, ((_, y),) in by_id.items())


def test_weights_count(lspark):
    n = lspark.range(6000).select(S.rendezvous(F.xxhash64("id"), [1.0, 3.0, 0.0, 2.0]).alias("s")).groupBy("s").count()
    n = {r["s"]: r["count"] for r in n.collect()}
    assert set(n) == {0, 1, 3}
    assert abs(n[1] / 6000 - 0.5) < 0.03 and abs(n[3] / 6000 - 1 / 3) < 0.03


def test_records_are_written_whole(docs_of, lspark, tmp_path):
    docs = docs_of(ROWS)
    S.write_shards(docs, str(tmp_path / "out"), 4, files_per_shard=2)
    back = lspark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    want = {r["doc_id"]: r["shard"] for r in S.assign_shards(docs, 4).collect() if r["doc_id"] is not None}
    assert all(want[r["doc_id"]] == r["shard"] for r in back.where("doc_id is not null").collect())


def test_empty_table(docs_of):
    assert S.assign_shards(docs_of([])).collect() == []
