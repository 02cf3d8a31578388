import hashlib
import io
import random
import struct
from datetime import datetime

import pytest
import zstandard

from linescan.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload binary"
MARK = struct.pack("<I", warc.FRAME)


def archive(records, dictionary=None, raw=False):
    body = b""
    if dictionary is not None:
        held = dictionary.as_bytes() if raw else zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        body = struct.pack("<II", warc.DICTIONARY_FRAME, len(held)) + held
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    return body + b"".join(packer.compress(r) for r in records)


def page(i, text=b"<html>some page</html>"):
    return warc.page_record(i, f"http://x/{i}", text, len(text), hashlib.sha256(text).hexdigest(), None, "2024-01-01T00:00:00Z")


@pytest.fixture(params=[1 << 20, 7])
def chunk(request, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", request.param)


def test_frames(chunk):
    records = [page(i, b"<p>%d</p>" % i * 50) for i in range(40)]
    dictionary = warc.fitted_dictionary([page(i, b"".join(hashlib.sha256(b"%d" % (j % 97)).digest() for j in range(i, i + 400))) for i in range(40)])
    assert dictionary is not None
    skipped = struct.pack("<II", 0x184D2A53, 5) + b"other"
    for made in (archive(records), archive(records, dictionary), archive(records, dictionary, raw=True)):
        assert [r for _, r in warc.frames(io.BytesIO(made))] == records
        assert [r for _, r in warc.frames(io.BytesIO(made + skipped + archive(records[:1]) * (b"*M\x18" not in made[:4])))][:40] == records
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_damage_costs_one_record(chunk):
    records = [page(i) for i in range(5)]
    made = [archive([r]) for r in records]
    good = lambda data: [r for _, r in warc.frames(io.BytesIO(data)) if isinstance(r, bytes)]
    bad = lambda data: [(at, str(r)) for at, r in warc.frames(io.BytesIO(data)) if not isinstance(r, bytes)]
    flipped = bytearray(made[2])
    flipped[len(flipped) // 2] ^= 0xFF
    data = b"".join([*made[:2], bytes(flipped), *made[3:]])
    assert good(data) == [r for i, r in enumerate(records) if i != 2] and bad(data)[0][0] == len(made[0] + made[1])
    assert good(made[0] + b"some rubbish" + made[1]) == records[:2]
    assert good(made[0] + made[1][:-3]) == records[:1] and "cut short" in bad(made[0] + made[1][:-3])[0][1]
    assert good(made[0] + b"\x28\xb5") == records[:1] and good(b"rubbish alone") == []
    lost = struct.pack("<II", warc.DICTIONARY_FRAME, 6) + b"nodict" + made[0]
    assert good(lost) == records[:1] and "dictionary" in bad(lost)[0][1]


def test_records_are_checked():
    whole = page(7, b"text")
    assert warc.parsed(whole)["payload"] == b"text" and warc.page_of(warc.parsed(whole)["record_id"]) == 7
    revisit = warc.page_record(8, None, None, 4, "ab" * 32, 7, "2024-01-01T00:00:00Z")
    assert {k: warc.parsed(revisit)[k] for k in ("record_type", "refers_to", "payload_bytes", "payload", "uri")} == {
        "record_type": "revisit", "refers_to": "<urn:page:7>", "payload_bytes": 4, "payload": None, "uri": None,
    }
    for old, new, said in (
        (b"WARC/1.1", b"WARC/2.0", "no WARC header"), (b"WARC-Type: response\r\n", b"", "no warc-type"), (b"WARC-Date: 2024", b"WARC-Date: 24", "WARC-Date"),
        (b"WARC-Type: response", b"no colon", "not a header"), (b"<urn:page:7>", b"page 7", "Record-ID"), (b"Content-Length: 4", b"Content-Length: 5", "digest"),
        (b"text\r\n\r\n", b"text\r\n\r\nmore", "Content-Length"), (b"text\r\n\r\n", b"texts\r\n\r", "end with"), (b"WARC-Type: response", b"WARC-Type: a\r\nWARC-Type: b", "repeated"),
        (b"text", b"tent", "digest"), (b"\r\n\r\n", b"", "no WARC header"),
    ):
        with pytest.raises(warc.Damaged, match=said):
            warc.parsed(whole.replace(old, new))
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody"
    about = [("WARC-Type", "response"), ("WARC-Record-ID", "<x:1>"), ("WARC-Date", "2024-01-01T00:00:00.5Z"), ("Content-Type", "application/http")]
    with pytest.raises(warc.Damaged, match="payload's"):
        warc.parsed(warc.record(about, http))
    with pytest.raises(warc.Damaged, match="revisit of nothing"):
        warc.parsed(warc.record([("WARC-Type", "revisit"), *about[1:]], http))
    assert warc.header_safe("http://x/a b\r\nEvil: 1") == "http://x/a%20b%0D%0AEvil:%201"


def expected(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        again = len(payload) >= 100 and bool(ids) and page_id != min(ids)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [50_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    rng = random.Random(3)
    pool = ["é" * 50, "x" * 99, "y" * 100, "", None, "long " * 600_000]
    rows = [(i, rng.choice([None, f"http://h/{i}\r\nX: y", "http://h/é"]), rng.choice([*pool[:5], f"<p>{i}</p>" * 30])) for i in range(300)]
    rows += [(301, "u", pool[5]), (302, "u", pool[5]), (None, "u", pool[2]), (None, None, "only here " * 20), rows[7], (rows[9][0], "u", "z" * 200), (rows[9][0], "u", "z" * 200), (400, "u", "z" * 200)]
    frame = spark.createDataFrame([(*r, "clash", b"clash") for r in rows], PAGES).repartition(3)
    warc.write_archives(frame, str(tmp_path / "a"), datetime(2024, 5, 1, 12))
    records = warc.read_archives(spark, str(tmp_path / "a"))
    assert sorted((tuple(r) for r in warc.pages_of(records).collect()), key=str) == expected(rows)
    back = {(r.record_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
    want = {(warc.page_urn(p), (h or "").encode()) for (p, _, h) in rows}
    assert back <= want and {p for _, p in back} == {(h or "").encode() for _, _, h in rows}
    about = records.where("record_type = 'warcinfo'").collect()
    assert len(about) == 3 and {r.date for r in about} == {"2024-05-01T12:00:00Z"} and not [p for p in (tmp_path / "a").iterdir() if p.suffix == ".tmp"]
    without = warc.read_archives(spark, str(tmp_path / "a"), payloads=False)
    assert without.where("payload IS NOT NULL").count() == 0 and without.count() == len(rows) + 3


def test_archives_with_damage_and_none(spark, tmp_path):
    folder = tmp_path / "given"
    (folder / "deep").mkdir(parents=True)
    (folder / "deep" / "other.warc.zst").write_bytes(archive([page(1), page(2)]) + b"rubbish" + archive([page(3), page(4)[:-1]]))
    (folder / ".hidden.warc.zst").write_bytes(b"")
    rows = warc.read_archives(spark, str(folder), strict=False).collect()
    assert [warc.page_of(r.record_id) for r in rows if not r.problem] == [1, 2, 3] and {r.file for r in rows} == {"deep/other.warc.zst"}
    assert [r.problem for r in rows if r.problem][0] == "no frame" and len([r for r in rows if r.problem]) == 2
    with pytest.raises(Exception, match="no frame"):
        warc.read_archives(spark, str(folder)).count()
    for made in (spark.createDataFrame([], PAGES),):
        warc.write_archives(made, str(tmp_path / "none"))
        assert warc.pages_of(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "missing")).count() == 0


def test_archives_roll_over_with_dictionaries(spark, tmp_path, monkeypatch):
    writer = warc.WarcWriter(str(tmp_path), "2024-01-01T00:00:00Z")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 400_000)
    import pyarrow as pa

    rng = random.Random(0)
    words = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(150)).encode() for _ in range(300)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array(["u"] * 300), pa.array(texts), pa.array(map(len, texts)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([None] * 300, pa.int64())],
        ["page_id", "uri", "payload", "n_bytes", "digest", "refers_to"],
    )
    (tmp_path / f".{writer.run}.failed.tmp").write_bytes(b"of another attempt")
    writer.commit([writer.write(iter([batch]))])
    files = sorted(tmp_path.iterdir())
    assert len(files) > 2 and all(f.name.endswith(".warc.zst") for f in files)
    found = [warc.parsed(r) for f in files for _, r in warc.frames(f.open("rb"))]
    assert sorted(r["payload"] for r in found if r["record_type"] == "response") == sorted(texts)
    assert files[0].read_bytes()[:4] == struct.pack("<I", warc.DICTIONARY_FRAME)
