import base64
import hashlib
import io
import struct
from collections import defaultdict

import zstandard

from yardstats.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def _expected(pages, least=0):
    same = defaultdict(list)
    for page, _, html, _ in pages:
        same[(html or "").encode()].append(page)
    out = []
    for payload, ids in same.items():
        ids.sort(key=lambda x: (x is None, x))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for place, page in enumerate(ids):
            revisit = place > 0 and len(payload) >= least
            out.append((page, len(payload), digest, "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=str)


def _found(pages, folder=None, least=0):
    rows = warc.read_archives(warc.archive_pages(pages, folder, least)).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


PAGES = [
    (1, "u", "x", ""), (1, "u", "x", ""), (1, "v", "x", ""), (None, None, "x", ""), (2, None, None, ""),
    (3, "a b\n", "", ""), (3, "a b\n", "", ""), (5, "é", "é\r\n\r\n" * 1000, ""), (None, "q", "zz", ""), (None, "q", "zz", ""),
    (6, "r", "WARC/1.1\r\n\r\n", ""),
]


def test_round_trip(rows):
    pages = rows(PAGES, SCHEMA)
    assert _found(pages) == _expected(PAGES)
    assert _found(pages, least=2) == _expected(PAGES, least=2)


def test_empty_table(rows):
    assert _found(rows([], SCHEMA)) == []


def test_archives_roll_over_and_hold_a_dictionary(rows, tmp_path, monkeypatch):
    pages = [(i, f"http://a/{i}", f"<html><body><p>page {i} of many</p></body></html>" * 20, "") for i in range(300)]
    folder = f"file://{tmp_path}/archives"
    # The tasks take the module's values with them.
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    listed = warc.archive_pages(rows(pages, SCHEMA).coalesce(1), folder).collect()
    assert sum(r.records for r in listed) == 300
    for row in listed:
        data = open(row.archive.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.SKIPPABLE and 0 < size <= warc.DICTIONARY_BYTES
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        # One frame per record.
        rest, frames = data[8 + size :], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, frames = one.unused_data, frames + 1
        assert frames == row.records
        assert len(list(warc.read_records(io.BytesIO(data)))) == row.records
