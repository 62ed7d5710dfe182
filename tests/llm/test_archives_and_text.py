import base64
import hashlib
import io
import random
import struct

import numpy as np
import pytest
import zstandard

from isofold.llm import licenses, permutation, pseudonyms, warc

from . import brute

PAGES = "page_id long, url string, html string, digest string, refers_to string"


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(2)
    html = [f"<html><body>{'lorem ipsum ' * r.randint(0, 400)}{k % 40}é</body></html>" for k in range(200)]
    rows = [(k, f"http://x/{k} y", h, "a", "b") for k, h in enumerate(html)] + [(300, None, None, None, None), (301, "u", "", None, None), (299, "u", None, None, None), (-5, "u", html[3], None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip(pages, tmp_path):
    out = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    payload = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    want = {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in payload.items()}
    assert out == want
    for f in (tmp_path / "w").glob("*.warc.zst"):
        data = f.read_bytes()
        for r in warc.read_archive(data):
            assert r.version == "WARC/1.1" and r.headers["warc-type"] in ("response", "revisit")


def test_pages_odd_rows(spark, pages):
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (2, "u", "y")], "page_id long, url string, html string")
    out = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(odd).collect()]
    assert sorted(out, key=repr) == [(1, 1, "response", None)] * 3 + [(2, 1, "revisit", 1), (None, 1, "revisit", 1)]
    lone = spark.createDataFrame([(None, "u", "z"), (None, "v", "z"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(lone).collect()) == [(0, "response", None), (1, "response", None), (1, "response", None)]
    longer = warc.archive_round_trip(odd, least_bytes=2).collect()
    assert {r["record_type"] for r in longer} == {"response"}


def archive(compress=True, dictionary=True):
    blocks = [b"<html>%d %s</html>" % (k, b"some shared text " * 30) for k in range(60)]
    content = warc.trained(blocks) if dictionary else b""
    assert bool(content) == dictionary
    out = io.BytesIO()
    w = warc.Writer(out, content)
    for k, b in enumerate(blocks):
        w.add([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z")], b)
    return out.getvalue(), blocks


@pytest.mark.parametrize("dictionary", [True, False])
def test_archive_reads_back(dictionary):
    data, blocks = archive(dictionary=dictionary)
    assert (struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC) == dictionary
    records = list(warc.read_archive(data))
    assert [r.block for r in records] == blocks and len({r.offset for r in records}) == 60


def test_plain_dictionary_frame():
    data, blocks = archive()
    size = struct.unpack("<I", data[4:8])[0]
    content = zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size])
    plain = warc.dictionary_frame(content, compress=False) + data[8 + size :]
    assert [r.block for r in warc.read_archive(plain)] == blocks


def frame(text: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(text)


HEAD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"


@pytest.mark.parametrize(
    "data",
    [
        frame(HEAD + b"Content-Length: 3\r\n\r\nab\r\n\r\n"),
        frame(HEAD + b"Content-Length: x\r\n\r\nab\r\n\r\n"),
        frame(HEAD + b"\r\nab\r\n\r\n"),
        frame(b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        frame(HEAD + b"no colon\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"),
        frame(HEAD + b"Content-Length: 2\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"),
        frame(HEAD.replace(b"response", b"other") + b"Content-Length: 2\r\n\r\nab\r\n\r\n"),
        frame(HEAD + b"WARC-Block-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"),
        frame(HEAD + b"Content-Length: 2\r\n\r\nab\r\n\r\n")[:-3],
        frame(HEAD + b"Content-Length: 2\r\n\r\nab\r\n\r\n") + b"junk beyond",
        frame(HEAD + b"Content-Length: 2\r\n\r\nab\r\n\r\n") + warc.dictionary_frame(b"late"),
        warc.dictionary_frame(b"x" * 100)[:-1],
    ],
)
def test_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data))


def foreign() -> tuple[bytes, list[tuple[str, str, bytes]]]:
    """An archive as other tools write it: a plain frame for each record, HTTP messages, no headers of ours, digests of several kinds."""
    page = b"<html>" + bytes(range(32, 127)) * 400 + b"</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    records = [("warcinfo", "<i>", b"software: x\r\n", []), ("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", [("Content-Type", "application/http;msgtype=request")])]
    records += [("response", f"<r{k}>", http + page, [("Content-Type", "application/http; msgtype=response"), ("WARC-Target-URI", f"http://h/{k}"), ("WARC-Payload-Digest", d)]) for k, d in enumerate([sha1, sha1.lower().replace("sha1:", "SHA1:"), "sha256:00ff", ""])]
    records += [("revisit", "<v>", b"", [("WARC-Payload-Digest", sha1)]), ("metadata", "<m>", b"a: b\r\n", [("X-Page-ID", "not a number")])]
    out, want = b"", []
    for kind, name, block, more in records:
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), *((k, v) for k, v in more if v)]
        out += frame(warc.serialized(head, block))
        want.append((kind, name, page if kind == "response" else b"" if kind == "request" else block))
    return out, want


@pytest.mark.parametrize("whole", [False, True])
def test_foreign_archive(spark, tmp_path, monkeypatch, whole):
    data, want = foreign()
    (tmp_path / "a.warc.zst").write_bytes(data)
    if whole:
        monkeypatch.setattr(warc, "_opens", lambda folder: False)
    out = {r["record_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert {k: (r["record_type"], bytes(r["payload"]) if r["payload"] is not None else None) for k, r in out.items()} == {n: (k, None if k == "revisit" else p) for k, n, p in want}
    assert all(r["page_id"] is None and r["refers_to"] is None and r["date"] for r in out.values())
    assert out["<r2>"]["payload_digest"] == "sha256:00ff" and out["<r3>"]["payload_digest"] == warc.digest(bytes(out["<r3>"]["payload"]))
    assert out["<r1>"]["target_uri"] == "http://h/1" and out["<i>"]["target_uri"] is None


class Slow(io.BytesIO):
    """Gives a few bytes at a time, and knows how many it was asked to hold back."""

    def read(self, n=-1):
        return super().read(min(n, 700) if n > 0 else 700)


def test_streams_hold_a_frame_at_a_time(monkeypatch):
    data, blocks = archive()
    assert [r.block for r in warc.read_archive(Slow(data))] == blocks
    source = warc._Source(Slow(data), chunk=500)
    most = 0
    real = warc._Source.has
    monkeypatch.setattr(warc, "CHUNK_BYTES", 500)
    monkeypatch.setattr(warc._Source, "has", lambda self, n: (real(self, n), globals().__setitem__("held", max(globals().get("held", 0), len(self.held))))[0])
    assert len(list(warc.read_frames(Slow(data)))) == 60 and source.has(1) and most == 0
    assert globals()["held"] < len(data) // 2


@pytest.mark.parametrize("data", [frame(b"WARC/1.1\r\nWARC-Type: r\xff\r\n\r\n"), b"\x28\xb5\x2f\xfd", b"abc", b"12345678junk", struct.pack("<II", warc.DICTIONARY_MAGIC, 8) + struct.pack("<I", warc._FRAME) + b"ruin"])
def test_more_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data))


def test_lost_attempts_leave_no_records(spark, pages, tmp_path):
    """A file that no finished task lists is none of the archives that are read back."""
    (tmp_path / "part-000000-0000-lost.warc.zst").write_bytes(b"half an arch")
    assert warc.archive_round_trip(pages, f"file://{tmp_path}").count() == 204


# ---------------------------------------------------------------- pseudonyms
@pytest.mark.parametrize("n", [1, 2, 7, 100, 73049, 10**14])
def test_feistel_is_a_permutation(n):
    f = pseudonyms.Feistel(b"k", "t", n)
    some = range(min(n, 200))
    images = [f(x) for x in some]
    assert len(set(images)) == len(images) and all(0 <= y < n for y in images) and [f(y, True) for y in images] == list(some)


SAMPLES = {
    "email": ["mail jo.Doe-7@mail2.example.com now"],
    "secret": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ip": ["at 193.195.198.107."],
    "date": ["2021-02-28", "on 31/12/1999", "12/31/1999", "01.02.2003"],
    "ssn": ["078-05-1120"],
    "phone": ["+1 (521) 555-2373", "(555) 123-4567", "+44 20 7946 0958"],
    "card": ["4713332104704538", "4111 1111 1111 1111"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in SAMPLES.items() for t in ts])
def test_values_become_others_of_their_kind(kind, text):
    one, counts = pseudonyms.Pseudonymizer(b"key")(text)
    assert counts == {kind: 1} and one != text
    again, same = pseudonyms.Pseudonymizer(b"key")(one)
    assert same == {kind: 1}
    assert pseudonyms.Pseudonymizer(b"key", back=True)(one)[0] == text
    assert pseudonyms.Pseudonymizer(b"other")(text)[0] != one
    if kind not in ("ip", "date"):
        assert len(one) == len(text)


@pytest.mark.parametrize("text", ["9870157079875996", "2021-02-30", "666-05-1120", "10.0.0.256", "version 2.0.", "1.2.3.4.5", "DE89370400440532013001", "a@b", "12345", "+1", "x" * 5000, "@" * 300])
def test_what_is_not_valid_stays(text):
    assert pseudonyms.Pseudonymizer()(text) == (text, {})


def test_pseudonyms_table(odd_docs, no_docs, spark):
    out = pseudonyms.pseudonymized(odd_docs)
    assert out.columns == [*odd_docs.columns, "pii_counts"] and out.count() == odd_docs.count()
    assert pseudonyms.pseudonymized(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "call +1 (521) 555-2373"), (2, None), (3, "+1 (521) 555-2373 again"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymized(docs).collect()}
    assert got[1]["text"].split("call ")[1] == got[3]["text"].split(" again")[0] != "+1 (521) 555-2373"
    assert got[2]["text"] is None and got[4]["text"] == "" and got[1]["pii_counts"] == {"phone": 1}


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("card 4111 1111 1111 1111 123 with its code", {"card": 1}),
        ("+1 555 123 4567 2020", {"phone": 1}),
        ("tel +44 20 7946 0958 2020-01-02", {"phone": 1, "date": 1}),
        ("ids 1234-5678-9012-3456 and 4111-1111-1111-1111-99", {"card": 1}),
        ("GB82 WEST 1234 5698 7654 32 1234", {"iban": 1}),
        ("host 2001:db8:85a3::8a2e:370:7334, at 12:34:56 in a::b", {"ipv6": 1}),
        ("ssn 078 05 1120 but 000 05 1120", {"ssn": 1}),
        ("192.168.100.1.", {"ip": 1}),
        ("mail <jo@own-domain.fr>; JO@OWN-DOMAIN.FR", {"email": 2}),
        ("call 555 123 4567 or 1 555 123 4567, not 12 555 123 4567", {"phone": 2}),
        ("tel +49 (0)30 1234567 and +44 (0)20 7946 0958", {"phone": 2}),
        ("4111\u00a01111\u00a01111\u00a01111 4111.1111.1111.1111 4111 1111\n1111 1111", {"card": 3}),
        ("years 2001.2002.2003.2000 and 4111\n1111\n1111\n1111 or 2221\n0000 0000 0009", {}),
        ("de89370400440532013000 and gb82 west 1234 5698 7654 32 that", {"iban": 2}),
        ("de89\u00a03704\u00a00044\u00a00532\u00a00130\u00a000", {"iban": 1}),
        ("user@bücher.de josé.garcia@acme.com jose\u0301@acme.com o'neil@acme.com", {"email": 4}),
        ("иван.петров@почта.рф Straße@x.de İx@firm.com.tr", {"email": 3}),
        ("a" * 300 + "." + "b7" * 40 + "@mail.acme.com", {"email": 1}),
        ("id AKIA" + "QWERTYUIOPASDFGH and ghp_" + "a1B2c3" * 6 + " sk-" + "abc123" * 5, {"secret": 3}),
        ("sk-learn-and-other-words-here, AKIASHORT, ghp_short1", {}),
        ("x4111111111111111x", {"card": 1}),
    ],
)
def test_longest_valid_forms(text, kinds):
    new, counts = pseudonyms.Pseudonymizer(b"key")(text)
    assert counts == kinds and (new, counts) == brute.pseudonymized(text, b"key", pseudonyms.KINDS)
    assert pseudonyms.Pseudonymizer(b"key", back=True)(new)[0] == text


def test_equal_values_stay_linked():
    worker = pseudonyms.Pseudonymizer(b"key")
    new = lambda t: worker(t)[0]
    assert new("+1 555 123 4567 2020") == new("+1 555 123 4567") + " 2020"
    assert new("4111 1111 1111 1111 123") == new("4111 1111 1111 1111") + " 123"
    assert new("Jo.Doe@Firm.org").lower() == new("jo.doe@firm.org") and "firm" not in new("jo.doe@firm.org")
    assert new("jo@gmail.com").endswith("@gmail.com")
    assert new("2001:DB8:0:0:1:0:0:1") == new("2001:db8::1:0:0:1")
    assert new("+49 (0)30 1234567").replace("(0)", "") == new("+49 30 1234567") and "1234567" not in new("+49 (0)30 1234567")
    assert new("(555) 123-4567")[1:] == new("555 123 4567")[:3] + ") " + new("555 123 4567")[4:7] + "-" + new("555 123 4567")[8:]
    assert new("de89 3704 0044 0532 0130 00").upper().replace(" ", "") == new("DE89370400440532013000")
    assert not any(part in new("josé.garcia@bücher.de") for part in ("josé", "garcia", "bücher", "é", "ü"))
    assert new("JOSÉ@ACME.COM").lower() == new("josé@acme.com")
    assert new("(555) 123-4567")[1:4] == new("+1 555 123 4567")[3:6]


def test_keys(spark):
    """Without a key a session has its own, which no source file knows; the setting's key is taken where there is one."""
    assert pseudonyms.session_key(spark) == pseudonyms.Pseudonymizer().key and len(pseudonyms.session_key(spark)) == 32
    spark.conf.set(pseudonyms.SETTING, "one")
    try:
        assert pseudonyms.session_key(spark) == b"one" == pseudonyms.Pseudonymizer().key
    finally:
        spark.conf.unset(pseudonyms.SETTING)
    assert pseudonyms.session_key(spark) != b"one"


def test_pseudonyms_query_equals_plain(spark, sf):
    """The whole query against a plain version that tries every place of every text."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in pseudonyms.op4_pii_feistel(spark, sf).collect()}
    assert set(out) == set(texts)
    some = 0
    for d, text in texts.items():
        want, counts = brute.pseudonymized(text, pseudonyms.session_key(spark), pseudonyms.KINDS) if len(text) < 5000 else pseudonyms.Pseudonymizer()(text)
        r = out[d].asDict()
        assert r["text"] == want and r["n_values"] == sum(counts.values()) and all(r[f"n_{k}"] == counts.get(k, 0) for k, _, _ in pseudonyms.KINDS)
        some += bool(counts)
    assert some > 3


def test_tokens_without_digits_and_long_texts(spark):
    """A text without digits or at signs is looked at for tokens; long words are read once."""
    docs = spark.createDataFrame([(1, "key AKIA" + "ABCDEFGH" * 2), (2, "a." * 500_000 + "1"), (3, "no value")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymized(docs, b"k").collect()}
    assert got[1]["pii_counts"] == {"secret": 1} and got[1]["text"].startswith("key AKIA") and "ABCDEFGH" not in got[1]["text"]
    assert got[2]["pii_counts"] == {} == got[3]["pii_counts"] and got[2]["text"] == "a." * 500_000 + "1"


def test_pseudonyms_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.fr", 5, "x")], "doc_id long, text string, pii_counts int, `c1.d` string")
    assert pseudonyms.pseudonymized(docs, b"k").columns == ["doc_id", "text", "c1.d", "pii_counts"]
    assert [tuple(r)[2:] for r in pseudonyms.pseudonymized(docs, b"k", counts=None).collect()] == [(5, "x")]


# ---------------------------------------------------------------- licenses
def test_licenses(spark, odd_docs, no_docs):
    filler = "word " * 50
    mit = licenses.TEMPLATES["MIT-text"]
    damaged = mit.split()
    del damaged[40], damaged[60]
    damaged[10] = "other"
    rows = [(1, filler + licenses.TEMPLATES["GPL-3.0"] + filler), (2, filler + " ".join(damaged) + " " + filler), (3, "licensed under the moon"), (4, None), (5, filler), (6, licenses.TEMPLATES["MIT"] + " x y z " + licenses.TEMPLATES["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {}
    for r in licenses.license_matches(docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == {1, 2, 6}
    r = out[1][0]
    assert (r["license"], r["coverage"]) == ("GPL-3.0", 1.0) and rows[0][1][r["first_char"] : r["end_char"]] == licenses.TEMPLATES["GPL-3.0"].rstrip(".")
    assert [x["license"] for x in out[2]] == ["MIT-text"] and 0.95 < out[2][0]["coverage"] < 1
    assert [(x["license"], x["first_word"]) for x in out[6]] == [("MIT", 0), ("MIT", 8)]
    assert licenses.license_matches(no_docs).count() == 0 and licenses.license_matches(odd_docs).count() == 0


def test_short_licenses_by_coverage(spark):
    """Changed, missing and added words down to the coverage; copies one after another stay apart."""
    texts = ["x y Released under a MIT License z", "see Licensed under CC DE NC 4.0 here", "Released under and with the MIT License", "Released q under q the q MIT q License", "Released under MIT License. Released under the MIT License.", "Released under MIT", "released the the the the under", "the mit"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["license"], r["n_matched"], r["first_word"], r["end_word"]) for r in licenses.license_matches(docs.coalesce(1)).collect())
    assert out == [(0, "MIT", 4, 2, 7), (1, "CC-BY-NC-4.0", 6, 1, 8), (2, "MIT", 5, 0, 7), (3, "MIT", 5, 0, 9), (4, "MIT", 4, 0, 4), (4, "MIT", 5, 4, 9)]
    for text, rows in ((t, [r for r in out if r[0] == i]) for i, t in enumerate(texts)):
        buf = np.frombuffer(text.encode(), np.uint8)
        words, index = licenses._words(buf, np.array([0, len(buf)]))[0], licenses.Index.of(licenses.TEMPLATES)
        assert [(index.names[t], n, x, y) for t, _, n, x, y in licenses.matches(words, index)] == [r[1:] for r in rows]


def test_whole_license_texts(spark):
    """A whole text is spanned to its end; its first part with another ending is named so."""
    ends = {"MIT-text": ("MIT-grant", "other dealings in the software"), "BSD-2-Clause": ("BSD-2-Clause-grant", "possibility of such damage"), "ISC": ("ISC-grant", "performance of this software")}
    rows, want = [], []
    for i, (name, (part, end)) in enumerate(ends.items()):
        whole, first = licenses.TEMPLATES[name], licenses.TEMPLATES[part]
        assert " ".join(whole.split()).lower().rstrip(".").endswith(end) and whole.startswith(first.rstrip("."))
        rows += [(2 * i, whole), (2 * i + 1, first + " all else is up to you " * 20), (10 + i, whole + " and " + first)]
        want += [(2 * i, name, 1.0), (2 * i + 1, part, 1.0), (10 + i, name, 1.0), (10 + i, part, 1.0)]
    out = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in out) == sorted(want)
    for r in out:
        text = dict(rows)[r["doc_id"]]
        if r["doc_id"] % 2 == 0 and r["doc_id"] < 6:
            assert text[r["end_char"] :] == "."


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_named(spark, name):
    """Licenses of one family are told apart; a whole text is given to one template."""
    index = licenses.Index.of(licenses.TEMPLATES)
    text = "some words before " + licenses.TEMPLATES[name] + " and some words after"
    buf = np.frombuffer(text.lower().encode(), np.uint8)
    out = licenses.matches(licenses._words(buf, np.array([0, len(buf)]))[0], index)
    assert [(index.names[t], share) for t, share, *_ in out] == [(name, 1.0)]


def test_families_are_told_apart(spark):
    texts = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 license": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0-notice",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted((r["doc_id"], r["license"]) for r in licenses.license_matches(docs).collect())
    assert out == list(enumerate(texts.values()))


def test_rare_words_pass_over_nothing():
    """Texts made of template words in any order, with gaps: every place that spans enough of a short template is found."""
    index = licenses.Index.of({"one": "released under the mit license", "two": "under the under the sun now", "three": "alpha beta gamma"})
    r = random.Random(3)
    for _ in range(200):
        text = " ".join(r.choice("released under the mit license sun now alpha beta gamma x y".split()) for _ in range(r.randint(1, 40)))
        buf = np.frombuffer(text.encode(), np.uint8)
        words = licenses._words(buf, np.array([0, len(buf)]))[0]
        t, w = licenses.short_starts(words, np.array([0, len(words)]), index, 8, 0.8)
        found = set(zip(t.tolist(), w.tolist()))
        for k in index.short:
            template = index.words[k].tolist()
            for i in range(len(words)):
                if words[i] in template and plain_lcs(template, words[i : i + len(template) + 8].tolist()) >= licenses._needed(index.words[k], 0.8):
                    spans = licenses._spans(words, index, np.array([k]), np.array([i]), 8, 0.8)
                    assert (k, i) in found or not spans


def test_ties_go_to_the_first():
    index = licenses.Index.of({"one": "alpha beta gamma delta", "two": "alpha beta gamma epsilon"})
    buf = np.frombuffer(b"alpha beta gamma zeta", np.uint8)
    assert [index.names[t] for t, *_ in licenses.matches(licenses._words(buf, np.array([0, 21]))[0], index, coverage=0.75)] == ["one"]


def test_license_query_finds_what_plain_windows_find(spark, sf):
    """Every window of every text against every template by a full table of common subsequences, without fingerprints or bands."""
    index = licenses.Index.of(licenses.TEMPLATES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out: dict[int, list] = {}
    for r in licenses.op8_license_winnowing(spark, sf).collect():
        out.setdefault(r["doc_id"], []).append(r)
    checked = 0
    for d, text in texts.items():
        buf = np.frombuffer(text.encode().lower(), np.uint8)
        words = licenses._words(buf, np.array([0, len(buf)]))[0] if len(buf) else np.zeros(0, np.uint64)
        best = {}
        for t, template in enumerate(index.words):
            need = licenses._needed(template, licenses.COVERAGE)
            ours = np.concatenate(([0], np.cumsum(np.isin(words, template))))
            for i in range(len(words)):
                end = min(len(words), i + len(template))
                if words[i] in template and ours[end] - ours[i] >= need and (n := plain_lcs(template.tolist(), words[i:end].tolist())) >= need:
                    best[t] = max(best.get(t, 0), n / len(template))
        spans = out.get(d, [])
        assert bool(best) <= bool(spans)
        if best:
            checked += 1
            top = max(best.values())
            assert any(r["coverage"] >= top - 1e-9 for r in spans) or top < 1
        for r in spans:
            t = index.names.index(r["license"])
            assert plain_lcs(index.words[t].tolist(), words[r["first_word"] : r["end_word"]].tolist()) >= r["n_matched"] == round(r["coverage"] * len(index.words[t]))
            assert r["coverage"] >= licenses.COVERAGE and text[r["first_char"] : r["end_char"]].strip() == text[r["first_char"] : r["end_char"]]
    assert checked >= 3


def plain_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (a[i] == b[j]))
    return t[-1, -1]


def test_alignment_equals_plain_within_a_wide_band():
    r = random.Random(4)
    for _ in range(30):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 12))] for _ in range(2))
        n, first, last = licenses.aligned(np.array(b), np.array(a), 0, 14)
        assert n == plain_lcs(a, b)
        if n:
            assert plain_lcs(a, b[first:last]) == n


# ---------------------------------------------------------------- neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:740] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] + [1.0] * 15, 1), (2300, [None] + [1.0] * 15, 1), (2400, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    out = permutation.nearest_neighbours(df, shard_rows=400).toPandas()
    assert set(out["query_id"]) == set(range(0, 1500, 100)) and (out.groupby("query_id").size() == 10).all()
    y = x.astype(float)
    recall = []
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert np.allclose(g["score"], d[g["vec_id"]], atol=1e-12) and q not in set(g["vec_id"])
        assert list(zip(g["score"], g["vec_id"])) == sorted(zip(g["score"], g["vec_id"])) and list(g["rank"]) == list(range(1, 11))
        ids = np.array([i for i in range(1500) if i != q])
        recall.append(len(set(ids[np.lexsort((ids, d[ids]))[:10]]) & set(g["vec_id"])) / 10)
    assert np.mean(recall) >= 0.9
    tied = out[out["query_id"] == 700].sort_values("rank")
    assert list(tied["vec_id"]) == [7, *range(701, 710)]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert permutation.nearest_neighbours(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.1])], schema)
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in permutation.nearest_neighbours(few).collect())
    assert out == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    rows += [rows[100]] * 30  # a query that stands there often
    rows += [(200, (np.array(rows[200][1]) + e).tolist()) for e in (0.5, 1.0)]  # a query with three vectors
    rows += [(100 + k, rows[0][1]) for k in range(0, 30)] + [(0, rows[0][1])] * 30  # a class of equal vectors
    rows += [(7, (np.array(rows[100][1]) + e).tolist()) for e in np.linspace(1e-4, 2e-4, 40)]  # a neighbour with many vectors
    out: dict[int, list] = {}
    for r in permutation.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), share=1.0, shard_rows=150).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in (0, 100, 200):
        best: dict[int, float] = {}
        for v in [np.array(v) for i, v in rows if i == q]:
            for i, w in rows:
                if i != q:
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(w) - v) ** 2).sum())))
        want = sorted((d, i) for i, d in best.items())[:10]
        assert [i for _, i in out[q]] == [i for _, i in want] and np.allclose([d for d, _ in out[q]], [d for d, _ in want])


def test_index_prunes_and_finds(spark):
    """Production parameters on a whole table: recall by brute force, and how much of the index a query reads and reranks."""
    rows = permutation.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    x, ids = np.stack([np.frombuffer(v) for v in rows["vec"]]), rows["vec_id"].to_numpy()
    out = permutation.op5_permutation_index(spark, "/root/testdata/sf0.1").toPandas()
    recall = []
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        recall.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(g["vec_id"])) / 10)
    assert np.mean(recall) >= 0.9
    pivots = x[np.random.default_rng(0).permutation(len(x))[: permutation.PIVOTS]]
    orders = permutation._orders(x, pivots, permutation.LENGTH)
    files = permutation.InvertedFiles(orders, len(pivots))
    touched = [(files.shared(o) > 0).mean() for o in orders[::100]]
    read = [sum(files.at[p + 1] - files.at[p] for p in o) / len(x) for o in orders[::100]]
    assert np.mean(touched) < 0.65 and np.mean(read) < 2 * permutation.LENGTH**2 / permutation.PIVOTS


def test_few_in_files_means_all():
    orders = np.array([[0, 1], [0, 1], [2, 3], [2, 3], [2, 3]])
    files = permutation.InvertedFiles(orders, 4)
    assert files.nearest(np.array([0, 1]), 3, 2).tolist() == [0, 1] and files.nearest(np.array([0, 1]), 3, 3).tolist() == [0, 1, 2, 3, 4]


def test_orders_break_ties_by_pivot():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    assert permutation._orders(x[:1], x, 2).tolist() == [[0, 2]]


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(0)
    orders = np.array([rng.permutation(12)[:7] for _ in range(50)])
    files = permutation.InvertedFiles(orders, 12)
    rank = np.full((50, 12), 7)
    for i, o in enumerate(orders):
        rank[i, o] = np.arange(7)
    for q in range(5):
        foot = np.abs(rank - rank[q]).sum(1)
        near = set(files.nearest(orders[q], 8).tolist())
        cut = np.sort(foot)[7]
        assert near == set(np.flatnonzero(foot <= cut).tolist())
