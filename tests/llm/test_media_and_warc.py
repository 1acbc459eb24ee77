import hashlib
import io
import zlib

import numpy as np
import pytest

from semforge.llm import media, warc
from semforge.llm.common import new_path

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("seed", range(6))
def test_jpeg_round_trip(seed):
    rng = np.random.default_rng(seed)
    kinds = [lambda n: rng.integers(0, 256, n), lambda n: np.full(n, 128), lambda n: rng.choice([126, 127, 128, 129, 130], n), lambda n: rng.choice([128] * 9 + [255, 0], n), lambda n: rng.integers(97, 123, n), lambda n: np.full(n, 255)]
    payloads = [k(576 * int(rng.integers(1, 9))).astype(np.uint8) for k in kinds]
    stored = media.encode(payloads)
    c, begin, about = media.coefficients(stored)
    for k, p in enumerate(payloads):
        assert np.array_equal(media.coefficient_table()[1][c[begin[k] : begin[k + 1]] + 128].ravel()[: about[k][0]], p)
        assert media.encode([p])[0] == stored[k]


def test_transform_of_a_flat_block():
    c = np.zeros((1, 6, 64), np.int32)
    c[:, :, 0] = 80
    s = media.samples(c)
    assert (s == 138).all()
    assert (media.rgb(np.full((1, 6, 8, 8), 128, np.uint8)) == 128).all()


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 400), (4, "é" * 400), (None, "abc"), (7, "long " * 90_000)]
    out = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        t = next(t for d, t in rows if d == r.doc_id) or ""
        raw = t.encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    same = [r for r in out if r.doc_id == 4]
    assert same[0] == same[1] and {r.feature for r in out if r.doc_id in (1, 2)} == {out[0].feature} if out[0].doc_id in (1, 2) else True


def test_rgb_tensors_are_kept(spark):
    df = media.decoded(media.encoded(spark.createDataFrame([(1, "some text")], "doc_id long, text string")), keep_rgb=True)
    r = df.first()
    assert len(r.rgb) == 3 * r.height * r.width


def test_archives(spark):
    rows = [(1, "http://a/\r\nX: y", "p" * 200), (2, "u", "p" * 200), (3, None, "p" * 99), (4, "u", "p" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 300_000), (None, "u", "p" * 200), (9, "u", "q" * 150), (9, "u", "q" * 150)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGE)).collect()
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = 1 if h == "p" * 200 and p != 1 else None
        want.append((p is None, p or 0, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want)


def test_pages_with_other_columns(spark):
    rows = [(1, "u", "p" * 200), (2, "u", "p" * 200), (None, None, None)]
    wide = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 AS digest", "2 AS refers_to", "3 AS d", "4 AS first", "5 AS n", "6 AS archive")
    assert sorted(map(str, warc.round_trip(wide).collect())) == sorted(map(str, warc.round_trip(spark.createDataFrame(rows, PAGE)).collect()))


def test_names_without_page_id():
    names = [next(warc.read_archive(io.BytesIO(warc.record(None, "u", b"x", hashlib.sha256(b"x").hexdigest(), None, row))))["fields"]["WARC-Record-ID"] for row in ("0-1", "0-2")]
    assert names == ["<urn:row:0-1>", "<urn:row:0-2>"] and warc._number(names[0]) is None and warc._number("<urn:page:7>") == 7


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_reader_is_sequential_and_strict():
    one = warc.record(1, "u", b"payload" * 50_000, hashlib.sha256(b"payload" * 50_000).hexdigest(), None)
    two = warc.record(2, "u", b"x", hashlib.sha256(b"x").hexdigest(), 1)
    found = list(warc.read_archive(io.BytesIO(one + two + b"\0\0"), keep_payload=True))
    assert [f["fields"]["WARC-Type"] for f in found] == ["response", "revisit"] and found[0]["payload"] == b"payload" * 50_000
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(one[:-20])))
    bad = warc.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None)
    with pytest.raises(warc.WarcError, match="payload digest"):
        list(warc.read_archive(io.BytesIO(bad)))
    long = zlib.compressobj(6, zlib.DEFLATED, 31)
    broken = long.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + long.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(broken)))


def test_paths_are_in_the_shared_folder(spark):
    assert "/semforge/" in new_path(spark, "x")
