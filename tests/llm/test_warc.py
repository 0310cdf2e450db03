import gzip
import hashlib
import random

import pytest

from tallyforge.llm.warc import EMPTY_MEMBER, gzip_member, make_record, read_archive, read_warc, round_trip


def record(k, payload=b"x" * 300, first=None):
    return make_record(k, f"http://a/{k}", payload, hashlib.sha256(payload).hexdigest(), first, "2024-01-01T00:00:00Z")


def ids(found):
    found = list(found)
    return [x.headers["warc-record-id"] for x in found if not isinstance(x, tuple)], [x for x in found if isinstance(x, tuple)]


@pytest.mark.parametrize("pack", [gzip_member, lambda x: x])
def test_sound_archive(pack):
    data = b"".join(pack(record(k)) + (EMPTY_MEMBER if pack is gzip_member else b"") for k in range(5))
    names, gaps = ids(read_archive(data))
    assert names == [f"<urn:page:{k}>" for k in range(5)] and gaps == []
    assert list(read_archive(b"")) == []


@pytest.mark.parametrize("pack", [gzip_member, lambda x: x])
def test_damage_costs_only_what_it_hits(pack):
    parts = [pack(record(k, bytes([65 + k]) * 500)) for k in range(6)]
    rnd = random.Random(1)
    for hit in range(6):
        for how in range(4):
            bad = list(parts)
            if how == 0:  # bytes changed
                at = rnd.randrange(len(bad[hit]) - 200, len(bad[hit]) - 8)  # no check covers single header lines
                bad[hit] = bad[hit][:at] + bytes(b ^ 0x5A for b in bad[hit][at : at + 4]) + bad[hit][at + 4 :]
            elif how == 1:  # cut short
                bad[hit] = bad[hit][: len(bad[hit]) // 2]
            elif how == 2:  # noise before
                bad[hit] = bytes(rnd.randrange(256) for _ in range(50)) + bad[hit]
            else:  # beginning lost
                bad[hit] = bad[hit][5:]
            data = b"".join(bad)
            names, gaps = ids(read_archive(data))
            rest = [f"<urn:page:{k}>" for k in range(6) if k != hit]
            assert [n for n in names if n != f"<urn:page:{hit}>"] == rest
            assert len(gaps) == 1 and gaps[0][0] >= sum(map(len, bad[:hit])) and gaps[0][1] <= sum(map(len, bad[: hit + 1]))
            covered = sum(x.stop - x.start for x in read_archive(data) if not isinstance(x, tuple)) + sum(b - a for a, b, _ in gaps)
            assert covered == len(data)


@pytest.mark.parametrize("pack", [gzip_member, lambda x: x])
def test_long_header(pack):
    url = "data:text/html," + "%41" * 40_000
    data = pack(make_record(1, url, b"x", hashlib.sha256(b"x").hexdigest(), None, "2024-01-01T00:00:00Z")) + pack(record(2))
    names, gaps = ids(read_archive(data))
    assert names == ["<urn:page:1>", "<urn:page:2>"] and gaps == []
    assert next(iter(read_archive(data))).headers["warc-target-uri"] == url


def test_damaged_record_in_a_member_of_several():
    rnd = random.Random(3)
    parts = [record(k, bytes(rnd.choices(b"abcdefgh", k=2000))) for k in range(6)]
    bad = [*parts[:2], parts[2][:-50] + b"y" * 46 + b"\r\n\r\n", *parts[3:]]
    data = gzip_member(b"".join(bad)) + gzip_member(record(9))
    names, gaps = ids(read_archive(data))
    assert names == [f"<urn:page:{k}>" for k in (0, 1, 3, 4, 5, 9)]
    assert [g[2] for g in gaps] == ["payload digest differs"] and gaps[0][:2] == (0, len(data) - len(gzip_member(record(9))))
    # A member cut short keeps what is before the cut, and the member after it.
    whole = gzip_member(b"".join(parts))
    names, gaps = ids(read_archive(whole[: len(whole) * 2 // 3] + gzip_member(record(9))))
    assert names[:3] == [f"<urn:page:{k}>" for k in range(3)] and names[-1] == "<urn:page:9>" and len(gaps) == 1


def test_long_url_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "data:," + "a" * 100_000, "x"), (2, "u", "y")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in round_trip(pages, f"file://{tmp_path}/long").collect()) == [1, 2]


def test_noise_is_one_gap():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    assert [(x[0], x[1]) for x in read_archive(data)] == [(0, 3000)]


def test_a_changed_payload_fails_its_digest():
    data = record(1).replace(b"x" * 300, b"x" * 299 + b"y") + record(2)
    names, gaps = ids(read_archive(data))
    assert names == ["<urn:page:2>"] and gaps[0][2] == "payload digest differs"


def test_round_trip(spark, tmp_path):
    texts = ["a" * 100, "a" * 100, "a" * 99, "a" * 99, None, "", "café \U0001f600 " * 40, "WARC/1.1\r\n\r\n" * 30, "a" * 100, "\x00" * 150, "\x00" * 150]
    rows = [(k + 10, f"http://x y/{k}\r\nEvil: 1" if k else None, t, 1) for k, t in enumerate(texts)] + [(None, "u", "a" * 100, 2), (10, "u", "a" * 100, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    wanted = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first = min((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= 100 and first is not None and page != first
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    path = f"file://{tmp_path}/warc"
    assert sorted(map(tuple, round_trip(pages, path).collect()), key=str) == sorted(wanted, key=str)
    # The files are plain gzip archives of WARC records.
    files = list((tmp_path / "warc").glob("*.txt"))
    assert files and all(gzip.decompress(f.read_bytes())[:9] in (b"WARC/1.1\r", b"") for f in files)
    whole = read_warc(spark, path)
    assert whole.where("kind = 'gap'").count() == 0
    assert sorted(bytes(r.payload) for r in whole.where("record_type = 'response' AND record_id = '<urn:page:16>'").collect()) == [texts[6].encode()]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none").count() == 0
