import base64
import hashlib
import json

import pytest

from flowsieve.llm import rollup as ro, warc

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><meta name="k" content="v &amp; w"><title> A  &lt;b&gt; </title><style>p{}</style><script>x="</p>";</script></head>
<body><!-- <p>no</p> --><h1>Head</h1><p>one <b>two</b>&nbsp;three<br>four</p><a href="/x?a=1&amp;b=2">link</a><img src='i.png'></body></html>"""


def test_text_and_metadata():
    assert warc.plain_text(PAGE) == "A <b>\nHead\none two three\nfour\nlink"
    m = warc.page_metadata(PAGE, "http://h/d/p")
    assert m["title"] == "A <b>" and {"name": "k", "content": "v & w"} in m["metas"]
    assert [x["url"] for x in m["links"]] == ["http://h/x?a=1&b=2", "http://h/d/i.png"]


def test_records_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://h/p", PAGE, "x"), (2, None, None, "y"), (None, "http://h/q", "", None), (1, "http://h/p", PAGE, "x")], "page_id long, url string, html string, record string")
    sources = {r.page_id: r.record for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    for r in rows:
        source, block = warc.parse(bytes(sources[r.page_id]))
        headers, content = warc.parse(bytes(r.record))
        h, s = dict(headers), dict(source)
        assert h["WARC-Refers-To"] == r.refers_to == s["WARC-Record-ID"] and h["WARC-Date"] == s["WARC-Date"] and h.get("WARC-Target-URI") == s.get("WARC-Target-URI")
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode() == r.block_digest
        assert int(h["Content-Length"]) == len(content) == r.content_length
        assert r.source_payload_digest == s["WARC-Payload-Digest"] == warc.digest(warc.http(block)[2])
        if r.type == "metadata":
            assert json.loads(content)["envelope"]["warc-header"] == s
    assert len({r.record_id for r in rows}) == 6  # the repeated page has the same records
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_other_records(spark):
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"x")
    assert warc.derive_record(info) == []
    folded = b"WARC/1.0\r\nWARC-Type: response\r\nX: a\r\n b\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    assert dict(warc.parse(folded)[0])["X"] == "a b"
    for bad in (b"nonsense", info[:-8]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_repeated_headers_are_kept():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nset-cookie: b=2\r\nSet-Cookie: a=1\r\n\r\n<p>x</p>"
    source = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>")], block)
    envelope = json.loads(warc.parse(warc.derive_record(source)[0]["record"])[1])["envelope"]
    assert envelope["warc-header"]["WARC-Concurrent-To"] == ["<urn:uuid:2>", "<urn:uuid:3>"] and envelope["warc-header"]["WARC-Type"] == "response"
    assert envelope["http-response"]["headers"] == {"Set-Cookie": ["a=1", "b=2", "a=1"], "Content-Type": "text/html"}


def answer(body, *headers, record_id="<urn:uuid:1>"):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{h}\r\n".encode() for h in headers) + b"\r\n" + body
    return warc.record([("WARC-Type", "response"), *([("WARC-Record-ID", record_id)] if record_id else [])], block)


@pytest.mark.parametrize("coding", ["gzip", "deflate", "raw", "zstd", "gzip, zstd", "unknown", "none"])
@pytest.mark.parametrize("chunks", [0, 7, 100_000])
def test_bodies_are_decoded(coding, chunks):
    import gzip
    import zlib

    import zstandard

    page = "<title>Ä</title><p>" + "one two " * 200 + "</p>"
    raw = zlib.compressobj(wbits=-15)
    packs = {"gzip": gzip.compress, "deflate": zlib.compress, "raw": lambda b: raw.compress(b) + raw.flush(), "zstd": zstandard.ZstdCompressor().compress}
    body = page.encode()
    for c in coding.split(", "):
        body = packs.get(c, lambda b: b)(body)
    sent, headers = body, ["Content-Type: text/html; charset=utf-8", *([f"Content-Encoding: {'deflate' if coding == 'raw' else coding}"] if coding != "none" else [])]
    if chunks:
        sent = b"".join(b"%x;x=1\r\n%b\r\n" % (len(body[i : i + chunks]), body[i : i + chunks]) for i in range(0, len(body), chunks)) + b"0\r\n\r\n"
        headers.append("Transfer-Encoding: chunked")
    meta, text = warc.derive_record(answer(sent, *headers))
    assert warc.parse(text["record"])[1].decode() == warc.plain_text(page)
    envelope = json.loads(warc.parse(meta["record"])[1])
    assert envelope["html"]["title"] == "Ä" and envelope["envelope"]["payload-digest"] == warc.digest(body)


def test_damaged_bodies_give_what_is_there():
    import gzip

    packed = gzip.compress(b"<p>" + bytes(range(32, 127)) * 200 + b"</p>")
    assert warc.decompressed(packed[:-20], ["gzip"]).startswith(b"<p> !")
    assert warc.decompressed(b"<p>plain</p>", ["gzip"]) == b"<p>plain</p>"
    assert warc.joined(b"5\r\nhello\r\n3\r\nab") == b"helloab" and warc.joined(b"zz") == b""


def test_bad_records_are_rows(spark):
    good = answer(b"<p>x</p>", "Content-Type: text/html")
    rows = [(1, good), (2, b"nonsense"), (3, good[:-20]), (4, answer(b"x", record_id=None)), (5, None), (None, b"")]
    got = warc.derive(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert sorted((str(r.page_id), r.type, bool(r.error), r.record is None) for r in got) == sorted([("1", "metadata", False, False), ("1", "conversion", False, False), ("2", None, True, True), ("3", None, True, True), ("4", None, True, True), ("None", None, True, True)], key=str) or len(got) == 6
    assert {r.page_id: r.error for r in got if r.error}.keys() == {2, 3, 4, None}


def test_files_of_records(spark, tmp_path):
    """Members, one stream, and plain files; damage is a row; a round trip."""
    import gzip

    made = [answer(f"<p>{i}</p>".encode() * (1 + 9000 * (i == 3)), "Content-Type: text/html", record_id=f"<urn:uuid:{i}>") for i in range(30)]
    (tmp_path / "in").mkdir()
    files = {"a.warc.gz": b"".join(map(gzip.compress, made)), "b.warc.gz": gzip.compress(b"".join(made)), "c.warc": b"".join(made), "d.warc": b"".join(made)[:-9], "e.warc.gz": b"".join(map(gzip.compress, made))[:-40], "f.warc": b"", "g.warc": b"junk\r\n\r\n"}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path / "in")).collect()
    by = {n: sorted((r for r in rows if r.file.endswith(n)), key=lambda r: r.ordinal) for n in files}
    whole = [m[:-4] for m in made]
    for n in "a.warc.gz", "b.warc.gz", "c.warc":
        assert [bytes(r.record) for r in by[n]] == whole and [r.ordinal for r in by[n]] == list(range(30))
    for n in "d.warc", "e.warc.gz":
        assert [bytes(r.record) for r in by[n][:-1]] == whole[:29] and by[n][-1].record is None and by[n][-1].error
    assert not by["f.warc"] and by["g.warc"][0].error
    derived = warc.derive(spark.createDataFrame(enumerate(made), "page_id long, record binary"))
    parts = warc.write_warc(derived.repartition(3), str(tmp_path / "out")).collect()
    assert sum(p.records for p in parts) == 60
    back = warc.read_warc(spark, str(tmp_path / "out" / "*.warc.gz"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record)[:-4] for r in derived.collect())


def test_query_equals_a_plain_version(spark, sf):
    """Every page of the table through another HTML parser; ids, digests and lengths from the texts."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Page(HTMLParser):
        def __init__(self, uri):
            super().__init__(convert_charrefs=True)
            self.words, self.links, self.uri, self.off = [], [], uri, 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "noscript", "template")
            a = dict(attrs)
            if tag in ("a", "link", "img", "iframe") and not self.off and (a.get("href") or a.get("src")):
                self.links.append(urljoin(self.uri, a.get("href") or a.get("src")))
            self.words.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "noscript", "template")
            self.words.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

        def handle_data(self, data):
            if not self.off:
                self.words.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = {(r.page_id, r.type): r for r in warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()}
    digests = {(r.page_id, r.type): r.record_sha256 for r in warc.op3_warc_derivatives(spark, sf).collect()}
    assert len(rows) == 2 * len(pages) == len(digests)
    for p in pages:
        plain = Page(p.url or "")
        plain.feed(p.html or "")
        plain.close()
        meta, text = rows[p.page_id, "metadata"], rows[p.page_id, "conversion"]
        block = warc.parse(bytes(text.record))[1].decode()
        assert block.split() == "".join(plain.words).split()
        assert [x["url"] for x in json.loads(warc.parse(bytes(meta.record))[1])["html"]["links"]] == plain.links
        assert meta.refers_to == text.refers_to and meta.source_payload_digest == warc.digest((p.html or "").encode())
        for r in (meta, text):
            assert digests[p.page_id, r.type] == hashlib.sha256(bytes(r.record)).hexdigest() and r.error is None


CHANGES = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long, change_id long"


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    r = ro.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, None, None, 1), ("insert", "a", "en", "1", 5, None, None, None, None, 2), ("insert", None, None, "1", None, None, None, None, None, 3), ("insert", "a", "en", "1", 5, None, None, None, None, 2)], CHANGES)
    two = spark.createDataFrame([("revise", "b", "de", "2", 7, "a", "en", "1", 5, 4), ("delete", "a", "en", "1", 10, None, None, None, None, 5)], CHANGES)
    assert r.commit("b1", one) and r.commit("b2", two)
    assert not r.commit("b1", one) and not r.commit("b2", two)
    want = {(None, None, "1", 1, 0), ("b", "de", "2", 1, 7)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and r.batches() == ["b1", "b2"] and not r.commit("b2", two)
    assert r.commit("b3", one.limit(0)) and r.commit("b4", two.where("op = 'revise'").selectExpr("'delete' AS op", "source", "lang", "version", "tokens"))
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == {(None, None, "1", 1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        r.commit("b5", one.withColumn("op", one.source))
    assert "b5" not in r.batches()
    with pytest.raises(ValueError):
        r.commit("a/b", one)


def insert(n, **more):
    return ("insert", "a", "en", "1", n, None, None, None, None, more.get("id"))


def test_null_change_ids_count_each(spark, tmp_path):
    r = ro.Rollup(spark, str(tmp_path / "r"))
    r.commit("b", spark.createDataFrame([insert(10), insert(20), insert(5, id=1), insert(5, id=1), insert(4, id=1)], CHANGES))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "1", 3, 34)]


def test_incomplete_revise_is_an_error(spark, tmp_path):
    r = ro.Rollup(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="old_source"):
        r.commit("b", spark.createDataFrame([("revise", "a", "en", "1", 3)], "op string, source string, lang string, version string, tokens long"))
    assert r.batches() == []


def test_commit_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    """A batch that comes after compaction listed its deltas stays a delta; a second compaction of the same base loses."""
    r, other = (ro.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    r.commit("b1", spark.createDataFrame([insert(10)], CHANGES))
    rows = r._rows

    def late(base, deltas):
        if not r.batches() == ["b1", "b2"]:
            assert other.commit("b2", spark.createDataFrame([insert(5)], CHANGES))
            monkeypatch.setattr(r, "_rows", rows)
            assert other.compact()
        return rows(base, deltas)

    monkeypatch.setattr(r, "_rows", late)
    assert not r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "1", 2, 15)]
    monkeypatch.setattr(r, "_rows", rows)
    reader = r.totals()  # planned before two more compactions' worth of files
    assert other.commit("b3", spark.createDataFrame([insert(1)], CHANGES)) and r.compact()
    assert [tuple(x) for x in reader.collect()] == [("a", "en", "1", 2, 15)]
    assert r.compact() and [tuple(x) for x in other.totals().collect()] == [("a", "en", "1", 3, 16)]
    assert not other.commit("b1", spark.createDataFrame([insert(10)], CHANGES))


def test_unfinished_marker_is_no_commit(spark, tmp_path):
    r = ro.Rollup(spark, str(tmp_path / "r"))
    (tmp_path / "r" / "commits").mkdir(parents=True)
    (tmp_path / "r" / "commits" / "b").write_text("")
    assert r.batches() == [] and r.totals().count() == 0
    assert r.commit("b", spark.createDataFrame([insert(7)], CHANGES)) and r.totals().first().tokens == 7


def test_tokens_by_two_vocabularies(spark, sf, docs, docs_rows, tmp_path):
    """Counts equal whole texts'; the history's totals equal SQL on the counts."""
    import duckdb
    import public_tokenizers
    from flowsieve.llm.encoding import Encoder

    from . import brute

    paths = dict(zip(ro.VERSIONS, map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))))
    made = {n: Encoder(p) for n, p in paths.items()}
    counts = ro.token_counts(docs, paths)
    want = sorted(((None, "a", "b", "é")[i % 4] or "", (None, "en", "de")[i % 3] or "", len(brute.words(t)), *(len(made[n].whole([t or ""])[0]) for n in ro.VERSIONS)) for i, t in docs_rows)
    assert sorted((r.source or "", r.lang or "", *tuple(r)[2:]) for r in counts.collect()) == want
    counts.write.parquet(str(tmp_path / "counts"))
    rollup = ro.Rollup(spark, str(tmp_path / "r"))
    ro.history(rollup, spark.read.parquet(str(tmp_path / "counts")))
    sql = f"select source, lang, '{ro.VERSIONS[1]}', count(*), sum({ro.VERSIONS[1]})::bigint from '{tmp_path}/counts/*.parquet' where n_words >= 20 group by all"
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in rollup.totals().collect()), key=key) == sorted(duckdb.sql(sql).fetchall(), key=key)
    rows = ro.op10_delta_rollup(spark, sf)
    assert rows.columns == ["source", "lang", "version", "documents", "tokens"] and rows.count() > 0
