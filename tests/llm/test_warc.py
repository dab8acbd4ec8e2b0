import hashlib

from pyspark.sql import functions as F

from folioscan.llm import warc

LONG = "<html>" + "ü" * 60 + "</html>"
ROWS = [
    (5, "http://a/1", LONG),
    (3, "http://a/2\r\nX: y", LONG),
    (9, None, LONG),
    (9, None, LONG),
    (3, "http://a/2", LONG),
    (None, "http://n", LONG),
    (1, "http://s", "short"),
    (2, "http://s", "short"),
    (4, "http://e", None),
    (6, "http://e", ""),
    (7, "http://x", "x" * 99),
    (8, "http://x", "x" * 99),
    (10, "http://y", "WARC/1.1\r\n\r\n" * 20),
    (11, "http://big", "z" * 3_000_000),
]


def brute(rows):
    least = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            least[b] = min(page, least.get(b, page))
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        to = least.get(b)
        revisit = to is not None and to != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, result):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    assert result(warc.archive_pages(pages)) == brute(ROWS)
    more = pages.select("*", *[F.lit(1).alias(c) for c in ("digest", "salt", "original", "payload")])
    assert result(warc.archive_pages(more)) == brute(ROWS)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_roll_and_name_originals(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(warc.resolve(pages), archive_bytes=1000).collect()
    assert sum(f["n_records"] for f in files) == len(ROWS) and len(files) > 1
    heads = [h for f in files for h, _ in warc.records(f["path"])]
    ids = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-refers-to"] in ids for h in revisits)
    assert all(h["warc-profile"] == warc.REVISIT for h in revisits)
    assert all("\r" not in h.get("warc-target-uri", "") for h in heads)
