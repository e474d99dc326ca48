import base64
import gzip
import hashlib
import random

from firegrid.llm import warc


def record(k, payload, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def split(found):
    found = list(found)
    return [w["record_id"] for k, _, _, w in found if k == "record"], [(b, e, w) for k, b, e, w in found if k == "gap"]


def test_sound_archive():
    data = b"".join(record(k, b"body %d" % k) for k in range(5))
    assert split(warc.salvage(data)) == ([f"urn:x-page:{k}" for k in range(5)], [])


def test_salvage_after_damage():
    parts = [record(k, b"WARC/1.1\r\nnot a record " * 3 + b"%d" % k) for k in range(6)]
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    broken = bytearray(b"".join(parts))
    broken[starts[1] + 20] ^= 0xFF  # a header name
    broken[starts[3] - 10] ^= 0xFF  # record 2's payload
    cut = bytes(broken)[: starts[5] + 40]  # the last record is cut off
    ids, gaps = split(warc.salvage(cut))
    assert {"urn:x-page:0", "urn:x-page:3", "urn:x-page:4"} <= set(ids) and "urn:x-page:2" not in ids and "urn:x-page:5" not in ids
    assert any(b == starts[2] and e == starts[3] and w == "payload digest" for b, e, w in gaps)
    assert gaps[-1][:2] == (starts[5], len(cut))


def test_salvage_gzip_members():
    parts = [gzip.compress(record(k, b"x" * 500 + b"%d" % k)) for k in range(5)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 0x55
    starts = [sum(map(len, parts[:k])) for k in range(6)]
    ids, gaps = split(warc.salvage(parts[0] + bytes(bad) + b"garbage" + parts[2] + parts[3][:-6] + parts[4]))
    assert ids[0] == "urn:x-page:0" and "urn:x-page:2" in ids and ids[-1] == "urn:x-page:4"
    assert gaps[0] == (starts[1], starts[2] + 7, "gzip member") and len(gaps) == 2


def test_write_and_read_back(spark, tmp_path):
    long = "ü" * 2000
    rows = [(1, "http://a/ b\r\nX: 1", long), (9, None, long), (9, None, long), (None, "u", long), (2, "u", None), (3, "u", "short"), (4, "u", "short"), (5, "u", "a\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as _sha", "2 as record")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"), per_file=3)
    got = warc.read_warc(spark, str(tmp_path / "w"))
    assert got.where("kind = 'gap'").count() == 0
    got = got.selectExpr("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "target_uri").toPandas()
    assert len(got) == len(rows) and (got.target_uri != "").all()
    kinds = {k: set(g.record_type) for k, g in got.groupby("record_id")}
    assert kinds["urn:x-page:9"] == {"response"} and kinds["urn:x-page:1"] == {"revisit"} and kinds["urn:x-page:"] == {"revisit"} and kinds["urn:x-page:3"] == {"response"}
    assert got[got.record_id == "urn:x-page:1"].payload_bytes.tolist() == [4000]
    assert got[got.record_id == "urn:x-page:5"].payload_digest.tolist() == [hashlib.sha1(rows[-1][2].encode()).hexdigest()]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_first_member_header_damaged():
    parts = [gzip.compress(record(k, b"x" * 300 + b"%d" % k)) for k in range(4)]
    for at in range(3):
        data = bytearray(b"".join(parts))
        data[at] ^= 0xFF
        ids, gaps = split(warc.salvage(bytes(data)))
        assert ids == [f"urn:x-page:{k}" for k in (1, 2, 3)] and [g[:2] for g in gaps] == [(0, len(parts[0]))]


def test_neighbouring_damaged_members_keep_their_heads():
    rng = random.Random(5)
    texts = [[record(10 * m + k, rng.randbytes(3000)) for k in range(4)] for m in range(3)]
    parts = [gzip.compress(b"".join(t)) for t in texts]
    bad = [bytearray(p) for p in parts[:2]]
    for b in bad:
        b[len(b) * 7 // 8] ^= 0x55
    ids, gaps = split(warc.salvage(bytes(bad[0] + bad[1]) + parts[2]))
    a, b = len(parts[0]), len(parts[0]) + len(parts[1])
    assert ids == [f"urn:x-page:{k}" for k in (0, 1, 2, 10, 11, 12, 20, 21, 22, 23)]
    assert gaps == [(0, a, "gzip member"), (a, b, "gzip member")]


def test_damage_in_the_middle_of_the_last_step_keeps_what_was_before():
    parts = [record(k, b"%d" % k * 200) for k in range(5)]
    whole = gzip.compress(b"".join(parts), 0)  # stored, so that offsets are known
    at = whole.index(parts[3]) + len(parts[3]) + 4
    ids, gaps = split(warc.salvage(whole[:at]))
    assert ids == [f"urn:x-page:{k}" for k in range(4)] and gaps == [(0, at, "gzip member")]
    broken = gzip.compress(b"".join(parts[:2]))[:-8] + b"\xff" * 8 + parts[4]
    assert split(warc.salvage(broken))[0] == ["urn:x-page:0", "urn:x-page:1", "urn:x-page:4"]


def test_members_and_plain_records_in_one_file():
    parts = [record(k, b"y" * 100 + b"%d" % k) for k in range(6)]
    zipped = [gzip.compress(p) for p in parts]
    ids, gaps = split(warc.salvage(zipped[0] + parts[1] + b"??" + zipped[2] + b"!" + parts[3] + zipped[4][:20] + parts[5]))
    assert ids == [f"urn:x-page:{k}" for k in (0, 1, 2, 3, 5)] and len(gaps) == 3


def test_digest_forms():
    good = record(1, b"payload")
    digest = hashlib.sha1(b"payload")
    base32 = base64.b32encode(digest.digest())
    line = b"sha1:" + digest.hexdigest().encode()
    for form in (b"sha1:" + base32, b"SHA-1:" + base32.lower(), digest.hexdigest().upper().encode()):
        (kind, _, _, found), *rest = warc.salvage(good.replace(line, form))
        assert kind == "record" and not rest and found["payload_digest"] == digest.hexdigest()
    for form in (b"md5:AbC=", b"blake3:00", b"sha256:" + b"0" * 64):
        (kind, _, _, found), *rest = warc.salvage(good.replace(line, form))
        assert kind == "record" and not rest and found["payload_digest"] == form.decode()
    for form in (b"sha1:" + base32[::-1], b"sha1:" + b"0" * 40, b"sha1:?"):
        assert split(warc.salvage(good.replace(line, form)))[1][0][2] == "payload digest"


def test_member_per_record_of_written_archives(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"page {k} é " * 60) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = bytearray(file.read_bytes())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    data[len(data) // 2] ^= 0x3C
    ids, gaps = split(warc.salvage(bytes(data)))
    assert len(set(ids)) >= 39 and len(gaps) == 1
    warc.write_warc(warc.page_records(pages), str(tmp_path / "plain"), compression="none")
    assert warc.read_warc(spark, str(tmp_path / "plain")).where("kind = 'record'").count() == 40


def test_member_of_a_large_record_ends_with_zero():
    for size in (10, (16 << 20) + 5):
        body = record(1, b"z" * size)[:-4]
        packed = warc.member(body) + b"\0"
        assert gzip.decompress(packed) == body + warc.END and split(warc.salvage(packed)) == (["urn:x-page:1"], [])


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(k, "u", "x" * (200_000 if k % 10 == 0 else 500)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.page_records(pages, min_bytes=10**6), str(tmp_path / "w"), per_file=20, file_bytes=500_000, compression="none")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 500_000 and sum(sizes) > 6 * 200_000
    assert warc.read_warc(spark, str(tmp_path / "w")).where("kind = 'record'").select("record_id").distinct().count() == 60


def test_block_digest():
    good = record(1, b"payload")
    block = good[good.index(b"HTTP/") : -4]
    line = b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode() + b"\r\nContent-Type: application/http"
    marked = good.replace(b"Content-Type: application/http", line)
    assert split(warc.salvage(marked)) == (["urn:x-page:1"], [])
    assert split(warc.salvage(marked.replace(b"200 OK", b"200 Ok")))[1][0][2] == "block digest"


def test_damage_anywhere_in_a_written_archive_costs_what_it_hits(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"page {k} " * 90) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    rng = random.Random(1)
    data = bytearray(file.read_bytes())
    for at in rng.sample(range(len(data)), 5):
        data[at] ^= 1 << rng.randrange(8)
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(data)
    found = warc.read_warc(spark, str(tmp_path / "w"))
    assert found.where("kind = 'record'").select("record_id").distinct().count() >= 295
    assert found.where("kind = 'gap'").count() <= 5
