import gzip
import io
import random

import pytest

from graphloom.llm.warc import _member, parse_head


@pytest.mark.parametrize("keep", [False, True])
def test_url_of_200_kb(keep):
    url = "http://a.b/" + "".join(random.Random(5).choices("abcdefghijklmnop0123456789", k=200_000))
    record = f"WARC/1.0\r\nWARC-Target-URI: {url}\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n".encode()
    raw = gzip.compress(record)
    head, end = _member(io.BytesIO(raw + gzip.compress(b"x")), 0, keep)
    assert end == len(raw) and parse_head(head)[0]["warc-target-uri"] == url
