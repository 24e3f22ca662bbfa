import gzip
import hashlib
import random
from collections import Counter, defaultdict

from text_samples import TEXTS, documents

from studyframe.llm import warc
from studyframe.llm.common import join_groups, new_folder
from studyframe.llm.exact_dedup import DigestIndex

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_dedup_of_odd_rows(docs, doubled, empty, spark):
    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    assert Counter(map(tuple, DigestIndex(spark).deduplicate(docs).select(*columns).collect())) == brute(TEXTS)
    assert Counter(map(tuple, DigestIndex(spark).deduplicate(doubled).select(*columns).collect())) == brute(TEXTS * 2)
    assert DigestIndex(spark).deduplicate(empty).count() == 0
    rows = [(1, "KELVIN K\u212a É", "s"), (2, "kelvin kk é", "s"), (3, "kelvin k\u212a É", "s")]  # only A-Z fold
    assert Counter(map(tuple, DigestIndex(spark).deduplicate(documents(spark, rows)).select(*columns).collect())) == brute(rows)


def test_index_remembers_earlier_batches(spark):
    index = DigestIndex(spark, buckets=3)
    first = index.deduplicate(documents(spark, [(1, "a", "s"), (2, "A", "s"), (3, "b", "s")])).collect()
    assert {r["doc_id"] for r in first if r["kept"]} == {2, 3}
    again = DigestIndex(spark, name=index.name, folder=index.folder, buckets=3).deduplicate(documents(spark, [(9, "a", "s"), (10, "c", "s")])).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"], r["known"]) for r in again} == {(9, 2, False, True), (10, 10, True, False)}
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 3, 10]
    fresh = documents(spark).selectExpr("unhex(sha2(text, 256)) as digest").join(index.read().hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the index is read in place


def test_batches_of_one_call_meet_in_the_index(docs, doubled, empty, spark):
    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    for batches in (1, 2, 5):
        index = DigestIndex(spark)
        found = index.deduplicate_in_batches(docs, batches=batches)
        index.drop()  # results outlive the name
        assert not spark.catalog.tableExists(index.name)
        assert Counter(map(tuple, found.select(*columns).collect())) == brute(TEXTS)
    assert Counter(map(tuple, DigestIndex(spark).deduplicate_in_batches(doubled).select(*columns).collect())) == brute(TEXTS * 2)
    assert DigestIndex(spark).deduplicate_in_batches(empty).count() == 0
    rows = [(i, f"t{i % 7}" if i % 3 else "hot", "s") for i in range(-40, 60)] + [(None, "t1", "s"), (None, "alone", "s")]
    assert Counter(map(tuple, DigestIndex(spark).deduplicate_in_batches(documents(spark, rows), batches=3).select(*columns).collect())) == brute(rows)
    index = DigestIndex(spark)
    index.deduplicate(documents(spark, [(500, "T1", "s")]))
    got = index.deduplicate_in_batches(documents(spark, rows)).where("text_sha256 = sha2('t1', 256)").collect()
    assert {(r["keep_id"], r["kept"], r["known"]) for r in got} == {(500, False, True)} and len({r["group_size"] for r in got}) == 1
    assert sorted(r["n"] for r in index.read().where("digest = unhex(sha2('t1', 256))").collect()) == [1]


def test_hot_keys_are_broadcast_and_others_joined(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else cast(id as string) end as k")
    groups = rows.where("k is not null").groupBy("k").count().selectExpr("k", "`count` as n", "concat('v', k) as v")
    got = join_groups(rows, groups, "k", "n", 5000, "id").collect()
    assert len(got) == 5000 and all(r["v"] == (None if r["k"] is None else "v" + r["k"]) for r in got)
    assert sum(r["n"] == 1667 for r in got) == 1667


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as refers_to", "1 as _digest")


def test_warc_round_trip(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "z" * 3_000_000), (2, "w", big)]
    got = Counter(tuple(r) for r in warc.round_trip(pages(spark, rows), new_folder(spark, "warc")).collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i is not None and i < 3
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    assert warc.round_trip(pages(spark, rows).where("false"), new_folder(spark, "warc")).count() == 0


def test_every_range_size_reads_each_record_once(spark, tmp_path):
    random.seed(4)
    bodies = [bytes(random.getrandbits(8) for _ in range(random.choice((0, 5, 900, 3000)))) + warc.MAGIC * random.randint(0, 3) for _ in range(50)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.record_bytes(i, f"http://x/{i}", b, i + 1 if i % 7 == 0 else None) for i, b in enumerate(bodies)))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == 50  # a plain reader opens it
    size = path.stat().st_size
    for step in (97, 1000, 4096, size + 1):
        records = [r for at in range(0, size, step) for r in warc.records_in(str(path), at, at + step)]
        assert [r[0] for r in records] == [f"urn:page:{i}" for i in range(50)]
        assert all(r[6] == b for i, (r, b) in enumerate(zip(records, bodies)) if i % 7)
    read = warc.read_archives(spark, warc.archive_files(spark, str(tmp_path)), range_bytes=1500)
    assert read.count() == 50


def test_junk_between_records_is_passed_over(tmp_path):
    path = tmp_path / "b.warc.gz"
    record = warc.record_bytes(1, "u", b"body", None)
    path.write_bytes(warc.MAGIC + b"junk" + gzip.compress(b"no warc") + record + b"\x1f\x8b" + record[: len(record) // 2])
    assert [r[6] for r in warc.records_in(str(path), 0, 10_000)] == [b"body"]
