import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from codelake.llm import arc_warc, token_files
from codelake.llm.common import shared_dir

from .conftest import ODD

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


TEXTS = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "x y ", "\n", "tab\t y", "a   ", " \n ", "don't it's 'll", "é ü  x", "a\x1c b", "<|endoftext|> hi", "日本 語", "a\r\n b c", "𝒳 𝒴", "a \x85", "can't  WON'T"]
TEXTS += ["naïve, été. ªº! mañana?! x.y don't. Ωmega. ǆabc ɐbc, word... word.,. a! !a . .. ... ,x x, É, été; ßs: Ǆ.", "the the. the, the; the! the the.", "x² x₂ ١ ۲. ⅷ ʰa µm. ñ. ﬁx, ĳ. 中文. 中, a中."]


def test_pieces_are_encoded_as_whole_texts(tokenizer):
    encoder = token_files.PieceEncoder(BPE, "<u2", most_pieces=3)
    for t in TEXTS * 2:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_encoded_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = token_files.PieceEncoder(path, "<u2"), Tokenizer.from_file(path)
    for t in TEXTS:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, docs_of, tokenizer, tmp_path):
    rows = [(i * 3 - 40, TEXTS[i % len(TEXTS)] * (1 + i % 5), "s") for i in range(200)]
    shards = token_files.write_dataset(docs_of(rows), str(tmp_path / "d"), BPE, end_id=2, bytes_per_shard=500)
    assert len(shards) > 3 and sum(n for _, n, _ in shards) == 200
    out = token_files.read_dataset(spark, str(tmp_path / "d"), shards, width=2).orderBy("doc_id").collect()
    start = 0
    for (i, text, _), r in zip(sorted(rows), out, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = sorted(p.name for p in (tmp_path / "d").iterdir())
    assert not [f for f in files if f.startswith(".")] and len(files) == 3 * len(shards)


def test_token_files_odd_rows(odd, none, tokenizer):
    out = token_files.round_trip(odd, BPE, end_id=2).collect()
    assert len(out) == 12 and sum(r["doc_id"] is None for r in out) == 1
    assert min(out, key=lambda r: r["start"])["doc_id"] is None
    by = {r["doc_id"]: r["n_tokens"] for r in out}
    assert by[1] == by[2] == 1
    assert sum(r["n_tokens"] for r in out) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    assert token_files.round_trip(none, BPE, end_id=2).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, payload string")


def brute_types(rows, least=1000):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and last[h or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return sorted(out)


def test_warc_round_trip(spark):
    copies = "<p>" + "same é " * 200
    rows = [(i, f"http://x.org/{i}", copies if i % 3 == 0 else "WARC/1.1\r\n\r\n" * i + f"page {i}\n") for i in range(90)]
    rows += [(200, None, None), (201, "bad url\nwith breaks", ""), (202, "http://x.org/#record=7", "x" * 300_000), (203, "u", "x" * 300_000), (204, "u", "y" * 999), (205, "u", "y" * 999)]
    rows += [(300, "u", "𝒳" * 250), (301, "u", "𝒳" * 250)]
    out = arc_warc.pages_round_trip(pages_of(spark, rows))
    assert sorted(map(tuple, out.collect())) == brute_types(rows)
    assert arc_warc.pages_round_trip(pages_of(spark, rows).where("false")).count() == 0


def test_arc_versions_and_damage():
    head1 = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 20\n1 0 org\nURL IP x y z"
    rest = b"\n\nhttp://a/ 1.2.3.4 20010203 text/html 5\nab\ncd\nhttp://b/ 1.2.3.4 20010203040506 image/gif 0\n\n"
    found = list(arc_warc.parse_arc(head1 + rest))
    assert [(r["url"], r["payload"], r["type"]) for r in found] == [("http://a/", b"ab\ncd", "text/html"), ("http://b/", b"", "image/gif")]
    assert arc_warc.warc_date(found[0]["date"]) == "2001-02-03T00:00:00Z"
    head2 = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 a.arc 8\n2 0 org\n"
    two = list(arc_warc.parse_arc(head2 + b"http://a/ 1.2.3.4 20010203040506 text/html 404 abc - 77 a.arc 3\nxyz\n"))
    assert [(r["result"], r["checksum"], r["offset"], r["payload"]) for r in two] == [("404", "abc", "77", b"xyz")]
    for broken in (b"http://a/ 1.2.3.4 2001 text/html 50\nshort\n", b"no header\n", b"a b c d x\n"):
        assert [bool(r["error"]) for r in arc_warc.parse_arc(broken)] == [True]
    assert list(arc_warc.parse_arc(b"")) == []


def test_identifiers_are_stable_and_headers_standard(spark, tmp_path):
    a = arc_warc.warc_identity("u", "d", "x")
    assert a == arc_warc.warc_identity("u", "d", "x") != arc_warc.warc_identity("u", "d", "y") and a.startswith("urn:uuid:")
    rows = [(1, "http://x/1", "p" * 2000), (2, "http://x/2", "p" * 2000)]
    arc_warc.pages_round_trip(pages_of(spark, rows), path=str(tmp_path / "w")).count()
    records = [r for p in (tmp_path / "w").glob("*.warc.gz") for r in arc_warc.parse_warc(p.open("rb"))]
    by = {h["WARC-Type"]: h for h, _ in records}
    assert by["revisit"]["WARC-Refers-To"] == by["response"]["WARC-Record-ID"] and by["revisit"]["Content-Length"] == "0"
    assert by["response"]["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(b"p" * 2000).hexdigest()
    assert shared_dir(spark)


def members(raw):
    """Where gzip members begin, and what each holds."""
    out, at = [], 0
    while at < len(raw):
        unpacker = zlib.decompressobj(31)
        plain = unpacker.decompress(raw[at:])
        out.append((at, plain))
        at = len(raw) - len(unpacker.unused_data)
    return out


def test_every_record_is_a_member_and_files_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"{i} " + chr(97 + i % 26) * 2_000_000 + str(np.random.default_rng(i).integers(0, 9, 60_000).tolist())) for i in range(50)]
    records = arc_warc.assign_types(arc_warc.convert(pages_of(spark, rows).select(arc_warc.arc_blob(*map(arc_warc.F.col, ("page_id", "url", "html")), arc_warc.F.lit("20010101000000"), arc_warc.F.lit(1)).alias("arc"))), arc_warc._key_of(arc_warc.F.col("target_uri")), 1000)
    files = arc_warc.write_warc(records.coalesce(2), str(tmp_path / "w"), bytes_per_file=400_000)
    listed = files.collect()
    assert sum(f["records"] for f in listed) == 50 and len(listed) > 4
    for f in listed:
        raw = (tmp_path / "w" / f["file"]).read_bytes()
        found = members(raw)
        assert len(found) == f["records"] and len(raw) == f["bytes"] < 400_000 + 300_000
        assert all(plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n") for _, plain in found)
    (tmp_path / "w" / "left-by-a-lost-task.warc.gz").write_bytes(raw)  # listed by nobody
    assert arc_warc.read_warc(files, str(tmp_path / "w")).count() == 50


def test_urls_are_percent_encoded(spark):
    urls = ["http://x/é", "http://x/日", "http://x/𝒳 y", "http://x/%20a", "http://x/a\tb"]
    got = [r[0] for r in pages_of(spark, [(i, u, "") for i, u in enumerate(urls)]).orderBy("page_id").select(arc_warc.percent_encoded(arc_warc.F.col("url"))).collect()]
    assert got == ["http://x/%C3%A9", "http://x/%E6%97%A5", "http://x/%F0%9D%92%B3%20y", "http://x/%20a", "http://x/a%09b"]


def test_broken_archives_are_refused():
    import io
    import zlib as z

    packer = z.compressobj(6, z.DEFLATED, 31)
    whole = packer.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n") + packer.flush()
    assert [b for _, b in arc_warc.parse_warc(io.BytesIO(whole * 3))] == [b"abcde"] * 3
    with pytest.raises(ValueError, match="broken off"):
        list(arc_warc.parse_warc(io.BytesIO(whole[:-20])))
