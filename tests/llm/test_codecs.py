import hashlib
import random
import zlib

import pandas
import pytest

from geolith.llm import media_ts, sentencepiece_codec, warc
from geolith.llm.queries import OP9, model_path, op9_warc

TEXTS = ["", " ", "  a  b ", "a▁b", "\ta\nb\r\n", "é😀\x00z", "\n\n", "a \n b\n", " \n", "x" * 5000, "Hello world. Hello  again,\nHello", "漢字 かな", "a b", "▁", " ▁ x"]


def test_codec_equals_the_library():
    c = sentencepiece_codec.Codec(model_path())
    rng = random.Random(4)
    alphabet = " \n\tabcé▁😀.,AB12"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert c.by_word
    for text in TEXTS + more:
        e = c.encode(text)
        assert e.ids.tolist() == c.library.encode(text)
        assert c.decode(e.ids.tolist()) == c.library.decode(c.library.encode(text))
        data = text.encode()
        assert len(e.ids) == len(e.starts) == len(e.ends)
        if len(e.ids):
            assert e.starts[0] == 0 and e.ends[-1] == len(data) and (e.starts[1:] == e.ends[:-1]).all()
        for i, a, b in zip(e.ids.tolist(), e.starts, e.ends):
            piece = c.library.id_to_piece(i)
            if not c.byte[i]:
                assert data[a:b].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))


def test_normaliser_equals_the_library():
    import sentencepiece

    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = next((v for n, _, v, _ in sentencepiece_codec._fields(library.serialized_model_proto()) if n == 3), None)
        ours = sentencepiece_codec.Normaliser(spec)
        for text in [*TEXTS, "ＡＢＣ　ｄｅｆ ①② ㌔ ﬁ", "ガギ  x ", "é A"]:
            got, align = ours(text.encode())
            assert got.decode().replace("▁", " ") == library.normalize(text).replace("▁", " ")
            assert len(align) == len(got) + 1 and align.tolist() == sorted(align.tolist())


def test_alignment_is_the_same_in_bulk():
    """Stretches copied at once get the places that one byte at a time would get."""
    plain = sentencepiece_codec.Normaliser(b"\x18\1\x20\0\x28\1")
    for text in [*TEXTS, "a  b", " é 漢 "]:
        data = (text or "").encode()
        got, align = plain(data)
        if not data:
            assert got == b"" and align.tolist() == [0]
            continue
        want, places = bytearray("▁".encode()), [0, 0, 0]
        for k, b in enumerate(data):
            piece = "▁".encode() if b == 32 else bytes([b])
            want += piece
            places += [k] * len(piece)
        assert got == bytes(want) and align.tolist() == [*places, len(data)]


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 4600, 4608, 4609, 100_000])
def test_streams_round_trip(size):
    n, payload = media_ts.padded("x" * size)
    assert n == size and len(payload) % 576 == 0 and payload
    media = media_ts.mux(payload)
    s = media_ts.demux(media)
    assert len(media) % 188 == 0 and s.payload == payload and not s.error and s.programs == {1: {256: 6}}
    assert [u.pts for u in s.units] == [3003 * (k + 1) for k in range(len(s.units))]
    assert [u.random_access for u in s.units] == [k % 16 == 0 for k in range(len(s.units))]
    assert [u.offset for u in s.units] == [4608 * k for k in range(len(s.units))]


def test_damaged_streams():
    media = media_ts.mux(media_ts.padded("y" * 20_000)[1])
    lost = media_ts.demux(media[: 188 * 40] + media[188 * 41 :])
    assert lost.error == "continuity" and lost.continuity_errors == 1
    again = media_ts.demux(media[: 188 * 40] + media[188 * 39 : 188 * 40] + media[188 * 40 :])
    assert again.continuity_errors == 0 and again.payload == media_ts.demux(media).payload
    assert media_ts.demux(b"").error == "length" and media_ts.demux(media[:-5]).error == "length"
    broken = bytearray(media)
    broken[10] ^= 255
    assert media_ts.demux(bytes(broken)).error == "tables"


def test_media_tables(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    read = {r["doc_id"]: r for r in media_ts.read_streams(media_ts.write_streams(df)).collect()}
    assert bytes(read[1]["payload"]).rstrip(b"\xff") == b"abc" and read[2]["units"][0]["random_access"] and read[1]["programs"] == "1:256=6"
    got = {r["doc_id"]: r for r in media_ts.stream_digests(df).collect()}
    payload = b"abc".ljust(576, b"\xff")
    assert got[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[1]["tail_crc32"] == zlib.crc32(payload[-32:]) and got[1]["n_bytes"] == 3


PAGES = [(5, "http://a/x", "<p>" + "dup " * 50), (3, "http://b/", "<p>" + "dup " * 50), (9, None, "<p>" + "dup " * 50), (1, "http://c", "short"), (2, "http://c", "short"), (4, "http://d", None), (7, "u r l", "é" * 60 + "\r\n\r\nWARC/1.1\r\n")]


def test_captures_match_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(OP9).df()
    got = op9_warc(spark, str(tmp_path)).toPandas()[list(want.columns)]
    plain = lambda f: sorted(str([None if pandas.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in f.astype(object).itertuples(index=False))
    assert plain(got) == plain(want)
    assert {r.page_id: r.record_type for r in got.itertuples()} == {3: "response", 5: "revisit", 9: "revisit", 1: "response", 2: "response", 4: "response", 7: "response"}


def test_captures_are_nested(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.read_records(warc.write_archives(df))
    assert records.count() == 3 * len(PAGES)
    got = warc.assemble(records).collect()
    assert len(got) == len(PAGES) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)
    whole = next(r["response"] for r in got if r["response"]["record_id"].startswith("<urn:page:7:"))
    assert bytes(whole["block"]).endswith(PAGES[-1][2].encode())


def record(kind, ident, block=b"", **more):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in more.items())
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_chains_orphans_and_breaks(spark):
    content = record("warcinfo", "i") + record("response", "r", b"HTTP/1.1 200\r\n\r\nbody") + record("request", "q", **{"WARC-Concurrent-To": "r"}) + record("metadata", "m", **{"WARC-Concurrent-To": "q"}) + record("request", "alone", **{"WARC-Concurrent-To": "gone"}) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx"
    archives = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"rubbish")), ("c", None)], "archive string, content binary")
    records = warc.read_records(archives)
    assert records.where("type = 'error'").count() == 2
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r", "gone"}
    assert [len(got["r"][k]) for k in ("requests", "metadata")] == [1, 1] and got["gone"]["response"] is None


def test_long_chains_circles_and_records_without_ids(spark):
    bare = lambda kind, block=b"", **more: record(kind, "", block, **more).replace(b"WARC-Record-ID: \r\n", b"")
    to = lambda x: {"WARC-Concurrent-To": x}
    parts = [record("response", "r", b"HTTP/1.1 200\r\n\r\nbody"), *[record("metadata", f"m{k}", **to(f"m{k - 1}" if k else "r")) for k in range(7)]]
    parts += [record("metadata", "x", **to("y")), record("metadata", "y", **to("z")), record("request", "z", **to("x"))]
    parts += [bare("response", b"HTTP/1.1 200\r\n\r\none"), bare("response", b"HTTP/1.1 200\r\n\r\ntwo"), bare("request"), bare("metadata", **to("r"))]
    archives = spark.createDataFrame([("a", bytearray(b"".join(parts)))], "archive string, content binary")
    got = warc.assemble(warc.read_records(archives)).collect()
    named = {r["capture_id"]: r for r in got if r["capture_id"] is not None}
    assert set(named) == {"r", "x"} and len(named["r"]["metadata"]) == 8
    assert named["x"]["response"] is None and len(named["x"]["requests"]) == 1 and len(named["x"]["metadata"]) == 2
    loose = [r for r in got if r["capture_id"] is None]
    assert sorted(bytes(r["response"]["block"])[-3:] if r["response"] else b"" for r in loose) == [b"", b"one", b"two"]
    assert all(len(r["requests"]) + len(r["metadata"]) == (r["response"] is None) for r in loose)


def test_no_pages(spark):
    assert warc.archived_captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
