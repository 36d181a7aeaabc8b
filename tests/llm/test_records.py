"""Archive and chat formatting: exact round trips."""

import base64
import hashlib

from pyspark.sql import functions as F

from slopewise.llm.archive import archived, base32_sha1, parsed, read_archive, write_archive
from slopewise.llm.chat import PART, format_chats, read_chats
from slopewise.session import scratch_path

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "u", "x\r\n\r\ny"), (5, "u", "x\r\n\r\ny"),
         (None, "n", "<p>é</p>"), (None, "n", "only null"), (None, "m", "only null"), (9, "", "long " * 5000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*r, b"q", 1) for r in PAGES], "page_id long, url string, html string, payload binary, address int")
    got = archived(pages).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((str(i), len((h or "").encode()), sha(h)) for i, _, h in PAGES)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for rows in by.values():
        first = [r for r in rows if r.record_type == "response"]
        assert len(first) == 1 and first[0].page_id == max((r.page_id for r in rows if r.page_id is not None), default=None)
        assert all(r.refers_to == first[0].page_id for r in rows if r.record_type == "revisit")
    assert archived(pages.limit(0)).count() == 0
    some = {r.page_id: r.record_type for r in archived(pages, least=9).collect() if r.page_id}
    assert some[1] == some[2] == "revisit" or some[2] == "response"
    assert some[3] == some[4] == "response"


def test_payloads_are_stored_once_and_checked(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_path(spark, "archive")
    write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in PAGES})
    records = read_archive(spark, path)
    assert all(bytes(r.record).endswith(bytes(r.payload) + b"\r\n\r\n") and bytes(r.record).startswith(b"WARC/1.1\r\n") for r in records.collect())
    damaged = records.withColumn("payload", F.lit(b"other")).withColumn("record", F.concat("header", F.lit(b"other\r\n\r\n")))
    assert parsed(damaged).filter("intact").count() == 0


def test_base32(spark):
    rows = spark.createDataFrame([(str(k) * k,) for k in range(60)], "t string")
    for r in rows.select("t", base32_sha1(F.col("t").cast("binary")).alias("d")).collect():
        assert r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode()


def test_chats_round_trip(spark):
    turns = [(1, 0, "user", "a</turn>\n<turn role=\"assistant\">b"), (1, 1, "assistant", "&lt; & &amp;lt; 🙂é\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "zwei"),
             (2, 0, None, "x"), (None, 1, 'q"<&', "y"), (3, None, "user", "late"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    rows = spark.createDataFrame([(*t, 7, "z") for t in turns], "conv_id long, turn long, role string, text string, at int, block string")
    got = {r.conv_id: r for r in read_chats(format_chats(rows)).collect()}
    plain = {r.conv_id: r.formatted for r in format_chats(rows).collect()}
    for conv in {t[0] for t in turns}:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_text == "".join(x for role, x in want if role == "assistant")
        assert got[conv].formatted_chars == len(plain[conv])
    assert format_chats(rows.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "look <b>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None),
             ("strange", "?", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts[:2]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content array<{PART}>")
    got = format_chats(rows, parts=F.col("content")).first()
    assert [(a.type, a.ref, a.tokens) for a in got.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1536), ("image", "i.png", 4)]
    for a in got.attachments:
        assert got.formatted[a.start :].startswith(f"<{a.type}/>")
    assert got.expanded_tokens == 1582 and [got.formatted[s.start : s.start + s.length] for s in got.loss] == ["look &lt;b><image/>"]
