import hashlib
from base64 import b32encode

import pytest

from tidemark.llm import warc

SCHEMA = "page_id bigint, url string, html string, data string, chunk_no int, block string, holder string"
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3\r\nWARC-Type: evil", "<p>same</p>"),
    (4, None, None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
    (7, "u", "é😀\n\r" * 500), (8, "u", "x" * 100_000), (None, "u", "no id"), (9, "u", "y\r"), (10, "u", "z\n"),
    (11, "u", "twice"), (11, "u", "twice"), (None, "u", "<p>same</p>"),
]


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def slow(pages, least=0):
    holder = {}
    for page, _, html in pages:
        if page is not None:
            holder[html or ""] = max(page, holder.get(html or "", page))
    out = []
    for page, _, html in pages:
        size = len((html or "").encode())
        top = holder.get(html or "")
        revisit = size >= least and top is not None and page != top
        out.append((page, size, digest(html), "revisit" if revisit else "response", top if revisit else None))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("chunk, least", [(7, 0), (64, 5), (1 << 16, 12)])
def test_archives_read_back_as_written(spark, tmp_path, chunk, least):
    path = str(tmp_path / "archives")
    warc.write_archives(pages_of(spark, PAGES), path, chunk, least)
    rows = warc.read_archives(spark, path).collect()
    assert all(r.intact for r in rows) and max(r.chunk_bytes for r in rows) <= chunk
    got = [(int(r.record_id.split(":")[-1] or -1), r) for r in rows]
    last = [(p if p >= 0 else None, r.bytes_so_far, r.digest_so_far, r.record_type,
             int(r.refers_to.split(":")[-1]) if r.refers_to else None) for p, r in got if r["last"]]
    assert sorted(last, key=key) == sorted(slow(PAGES, least), key=key)
    parts = sorted((r for p, r in got if p == 7), key=lambda r: r.chunk_no)
    whole = b"".join(bytes(r.data) for r in parts)
    assert whole.decode() == PAGES[6][2] and [r.chunk_no for r in parts] == list(range(1, len(parts) + 1))
    for i, part in enumerate(parts):  # the digest of all bytes up to the chunk's end
        upto = b"".join(bytes(r.data) for r in parts[:i + 1])
        assert part.digest_so_far == b32encode(hashlib.sha1(upto).digest()).decode()


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(pages_of(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def test_a_changed_payload_is_noticed():
    reader = warc._Reader(with_data=True)
    lines = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:"
             + digest("abc").encode() + b"\r\nX-Payload-Length: 3\r\nContent-Length: 7\r\n\r\nH\r\n\r\nxyz\r\n\r\n")
    lines = lines.replace(b"Content-Length: 7", b"Content-Length: 8")
    rows = [r for r in (reader.line(line) for line in lines.split(b"\n")) if r]
    assert [(r["data"], r["intact"]) for r in rows] == [(b"xyz", False)]
