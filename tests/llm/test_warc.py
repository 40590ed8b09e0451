"""Archives: revisits, and what is salvaged from damage."""

import gzip

from pyspark.sql import functions as F

from riskloom.llm import warc

ROWS = [(1, "http://a/", "same"), (2, None, "same"), (5, "http://b/ c\r\n", "same"), (3, "u", None), (4, "u", ""), (None, "n", "alone"), (7, "x", "é" * 70_000), (7, "x", "é" * 70_000)]


def archive(spark, tmp_path, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("sha1", F.lit(0))
    path = f"file://{tmp_path}/w"
    warc.write(df, path, id_col="page_id", url_col="url", payload_col="html")
    return path


def test_round_trip(spark, tmp_path):
    records = warc.read(spark, archive(spark, tmp_path))
    assert records.where("kind = 'gap'").count() == 0
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages(records).collect()), key=repr)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        kept = {"same": 5, "": 4, None: 4}.get(html)
        want.append((i, len(data), warc.digest(data), "response" if kept in (None, i) else "revisit", None if kept in (None, i) else kept))
    assert got == sorted(want, key=repr)


def test_files_are_plain_gzip_members(spark, tmp_path):
    archive(spark, tmp_path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == len(ROWS)


def test_no_rows(spark, tmp_path):
    assert warc.read(spark, archive(spark, tmp_path, [])).count() == 0


def parts(compressed):
    plain = [warc.build_record(i, f"http://h/{i}", b"payload %d " % i * 50, None) for i in range(6)]
    return [warc.member(p, 6) for p in plain] if compressed else plain


def check(data, lost, pieces):
    found = list(warc.salvage(data))
    assert [f[1] for f in found][0] == 0 and all(a[2] == b[1] or a[1:3] == b[1:3] for a, b in zip(found[:-1], found[1:], strict=True)) and found[-1][2] == len(data)
    kept = [int(f[3]["x-row-id"]) for f in found if f[0] == "record"]
    assert kept == [i for i in range(6) if i not in lost]
    gaps = [(f[1], f[2]) for f in found if f[0] == "gap"]
    assert (len(gaps) > 0) == bool(lost or sum(map(len, pieces)) != len(data))
    return found


def test_salvage():
    for compressed in (True, False):
        own = parts(compressed)
        check(b"".join(own), [], own)
        bad = bytearray(own[2])
        bad[len(bad) // 2] ^= 0xFF
        check(b"".join([*own[:2], bytes(bad), *own[3:]]), [2], own)
        check(b"".join([own[0], b"junk WARC/1.1\r\n junk \x1f\x8b\x08 junk", *own[1:]]), [], own)
        check(b"".join(own)[: -len(own[5]) // 2], [5], own)
        check(b"".join([own[0], own[1][: len(own[1]) // 2], *own[2:]]), [1], own)
    mixed = parts(True)[:3] + parts(False)[3:]
    check(b"".join(mixed), [], mixed)
    assert [f[0] for f in warc.salvage(b"nothing here")] == ["gap"]
    assert list(warc.salvage(b"")) == []


def test_wrong_length_is_quarantined():
    own = parts(False)
    own[1] = own[1].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1")
    check(b"".join(own), [1], own)


def test_salvage_inside_a_member():
    plain = parts(False)
    bad = bytearray(b"".join(plain))
    bad[len(plain[0]) + len(plain[1]) + len(plain[2]) // 2 + 200] ^= 0xFF
    found = check(gzip.compress(bytes(bad)) + warc.member(plain[0], 6)[:0], [2], plain)
    gap = next(f for f in found if f[0] == "gap")
    assert gap[5] == len(plain[0]) + len(plain[1]) and "digest" in gap[3]
    whole = gzip.compress(b"".join(plain), 0)
    for cut in (len(whole) - 4, len(whole) - len(plain[5]) // 2 - 8):  # the checksum, and the last record
        kept = [int(f[3]["x-row-id"]) for f in warc.salvage(whole[:cut]) if f[0] == "record"]
        assert kept == ([0, 1, 2, 3, 4, 5] if cut == len(whole) - 4 else [0, 1, 2, 3, 4])
    # A cut member, then a sound one: nothing of the second is lost.
    found = list(warc.salvage(whole[: len(whole) // 2] + warc.member(warc.build_record(77, "u", b"later", None), 6)))
    assert [int(f[3]["x-row-id"]) for f in found if f[0] == "record"][-1] == 77 and found[-2][0] == "gap"
    # Without a digest nothing confirms a record of a damaged member.
    bare = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" for _ in range(3))
    assert [f[0] for f in warc.salvage(gzip.compress(bare))] == ["record"] * 3
    assert [f[0] for f in warc.salvage(gzip.compress(bare)[:-3])] == ["gap"]


def test_members_larger_than_the_memory_of_a_reader(monkeypatch):
    monkeypatch.setattr(warc, "KEEP", 2000)
    monkeypatch.setattr(warc, "SLICE", 100)
    own = parts(False)
    data = gzip.compress(b"".join(own))
    check(data, [], [data])
    bad = bytearray(b"".join(own))
    bad[len(own[0]) + len(own[1]) - 100] ^= 1
    check(gzip.compress(bytes(bad)), [1], own)


def test_time_follows_length():
    import time

    rng = __import__("random").Random(1)
    member = [warc.member(warc.build_record(i, "u", rng.randbytes(3000), None), 1) for i in range(400)]
    seconds = []
    for times in (4, 40):
        data = b"".join(member) * times
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == 400 * times
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0]
