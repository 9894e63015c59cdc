import base64
import gzip
import hashlib
import random
from pathlib import Path

from tabsynth.llm import warc


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted(rnd.randint(0, 20) for _ in range(rnd.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_round_trip(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"
    rows = [(5, "http://www.A.com/x?y#z", "same"), (3, "http://b.a.com", "same"), (3, "http://b.a.com", "same"), (7, None, None), (9, "nonsense", ""), (8, "http://a.com/é\r\nX: y", trap), (None, "http://a.com/", "same"), (1, "http://a.com/", "Grüße\n🙂 " * 500), (2, "http://a.com/", "z")]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, digest string")
    index, path = warc.archive_pages(pages)
    got = index.collect()
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(p), len((h or "").encode()), digest(h)) for p, _, h in rows)
    revisits = sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [("3", 3), ("5", 3), ("9", 7), ("None", 3)]
    order = [(r.range_no, r.place) for r in got]
    by_order = [r for _, r in sorted(zip(order, got, strict=True), key=lambda x: x[0])]
    assert [(r.urlkey, r.date) for r in by_order] == sorted((r.urlkey, r.date) for r in got)
    assert {r.urlkey for r in got} >= {"", "com,a)/x?y", "com,a,b)/", "nonsense"}
    for r in got:  # offsets find the records
        raw = gzip.decompress(Path(f"{path.removeprefix('file:')}/{r.file}".replace("//", "/")).read_bytes())
        record = raw[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r.payload_digest.encode() in record
    assert warc.archive_pages(pages.limit(0))[0].count() == 0
