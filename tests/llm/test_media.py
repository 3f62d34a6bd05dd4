import hashlib
import tarfile
import zlib

from tamarack.llm import media as M
from tamarack.llm.common import table
from tamarack.operators.storage import new_path


def test_query_round_trip(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = M.op6_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    same = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(M.to_png(payload)).hexdigest()
        assert same.setdefault(docs[r.doc_id], tuple(r)[1:]) == tuple(r)[1:]


def test_ranges_hold_every_member_once_and_archives_are_plain_tar(spark):
    rows = [(i, "text %d " % i * (i % 50)) for i in range(400)] + [(None, None), (5, "again")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, media int").repartition(3)
    folder = new_path(spark, "test-media")
    M.store(docs, folder)
    for size in (700, 5000, 1 << 30):
        got = M.with_features(M.read_archives(spark, folder, size)).collect()
        assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
        assert all(r.error is None for r in got)
    where, root = M._file_system(folder)
    tars = [f.path for f in where.get_file_info(M.fs.FileSelector(root)) if f.path.endswith(".tar")]
    assert sum(len(tarfile.open(p).getmembers()) for p in tars) == len(rows)


def test_a_damaged_member_is_retried_and_reported_alone(spark):
    docs = spark.createDataFrame([(i, f"doc {i} " * 40) for i in range(20)], "doc_id long, text string").coalesce(1)
    folder = new_path(spark, "test-damage")
    M.store(docs, folder)
    where, root = M._file_system(folder)
    (path,) = [f.path for f in where.get_file_info(M.fs.FileSelector(root)) if f.path.endswith(".tar")]
    with tarfile.open(path) as tar:
        member = tar.getmembers()[7]
    with open(path, "r+b") as f:
        f.seek(member.offset_data + 60)
        f.write(b"\xff\x00\xff")
    got = {r.doc_id: r for r in M.with_features(M.read_archives(spark, folder)).collect()}
    assert len(got) == 20 and [i for i, r in got.items() if r.error] == [7] and got[7].payload_sha256 is None


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 400_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.media_columns(docs).collect()}
    assert got[1].n_bytes == 0 and got[1].payload_bytes == 192 and tuple(got[1])[1:] == tuple(got[2])[1:]
    assert got[3].n_bytes == 800_000 and got[3].payload_bytes % 192 == 0
    assert M.media_columns(docs.limit(0)).count() == 0
