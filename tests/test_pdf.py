"""Pages of generated PDF files: plain, with compressed streams, with object streams and a CID font, with forms; and broken ones."""

import zlib

import pytest
from pyspark.sql import functions as F

from lakequarry.sources import pdf


def made(objects, root=1, extra=b"", version=b"1.7"):
    """A file of objects (number: bytes) with a cross-reference table."""
    out, places = b"%PDF-" + version + b"\n%\xe2\xe3\xcf\xd3\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    table = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(max(objects) + 1))
    return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (max(objects) + 1, table, max(objects) + 1, root, extra, start)


def stream(body, head=b"", packed=False):
    data = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), head, b"/Filter /FlateDecode" if packed else b"", data)


def tree(n, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n))
    return {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, n), 3: font}


def plain():
    pages = [rb"BT /F1 12 Tf 72 700 Td (Hello \(world\) \351t\351) Tj 0 -14 Td [(ti) 20 (ght) -400 (gap)] TJ T* (third\nline) Tj ET", b"", rb"BT /F1 9 Tf 1 0 0 1 50 60 Tm (a) Tj 1 0 0 1 70 60 Tm (b) Tj 1 0 0 1 50 40 Tm (c) Tj ET BI /W 1 ID (x) Tj EI BT /F1 9 Tf (after) ' ET"]
    return made(tree(3) | {k: v for n, c in enumerate(pages) for k, v in ((10 + 2 * n, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * n)), (11 + 2 * n, stream(c)))})


def compressed():
    objects = tree(2) | {10: b"<< /Type /Page /Contents [11 0 R 14 0 R] >>", 11: stream(b"BT /F1 12 Tf (one ", packed=True), 14: stream(b"two) Tj ET", packed=True), 12: b"<< /Type /Page /Contents 13 0 R /Resources << /XObject << /X 15 0 R >> >> >>"}
    objects |= {13: stream(b"q /X Do Q", packed=True), 15: stream(b"BT /F1 1 Tf (in a form) Tj ET", b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 3 0 R >> >>", packed=True)}
    return made(objects)


def cid():
    """An object stream, and a font whose codes of two bytes mean characters by its map alone."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <9053> <0002> <8DEF> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<D83DDE00> <00660069>] endbfrange"
    packed = {2: b"<< /Type /Pages /Kids [10 0 R] /Count 1 /Resources << /Font << /F1 3 0 R >> >> >>", 3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 20 0 R >>", 10: b"<< /Type /Page /Contents 11 0 R >>"}
    head, body = b"", b""
    for n, x in packed.items():
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 11: stream(b"BT /F1 12 Tf <00010002> Tj <001000110012002000210099> Tj ET", packed=True), 20: stream(cmap, packed=True), 30: stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head)), packed=True)}
    return made(objects, version=b"1.5").replace(b"/Root 1 0 R", b"/Root 1 0 R")


FILES = {"plain.pdf": plain(), "compressed.pdf": compressed(), "cid.pdf": cid()}
PAGES = {"plain.pdf": ["Hello (world) été\ntight gap\nthird\nline", "", "ab\nc\nafter"], "compressed.pdf": ["one \ntwo", "in a form"], "cid.pdf": ["道路ABC😀fi�"]}
BROKEN = {
    "none.pdf": (b"hello", "no PDF header"), "secret.pdf": (made(tree(1) | {10: b"<< /Type /Page >>"}, extra=b"/Encrypt 9 0 R"), "encrypted"), "cut.pdf": (plain()[:200], "no pages"), "cycle.pdf": (made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R] >>"}), "cycle"),
    "flate.pdf": (made(tree(1) | {10: b"<< /Type /Page /Contents 11 0 R >>", 11: b"<< /Length 3 /Filter /FlateDecode >>\nstream\nabc\nendstream"}), "broken"), "large.pdf": (plain() + b" " * 20_000, "over 20000 bytes"),
    "filter.pdf": (made(tree(1) | {10: b"<< /Type /Page /Contents 11 0 R >>", 11: b"<< /Length 3 /Filter /LZWDecode >>\nstream\nabc\nendstream"}), "LZWDecode"),
}


def test_pages_of_each_kind(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    for name, (data, _) in BROKEN.items():
        (tmp_path / name).write_bytes(data)
    rows = pdf.read(spark, str(tmp_path), most_bytes=20_000).collect()
    by = {n: sorted((r for r in rows if r.file.endswith("/" + n)), key=lambda r: r.page or 0) for n in {*FILES, *BROKEN}}
    for name, pages in PAGES.items():
        assert [(r.page, r.total_pages, r.text, r.reason) for r in by[name]] == [(n, len(pages), t, None) for n, t in enumerate(pages, 1)]
    for name, (_, reason) in BROKEN.items():
        assert [(r.page, r.text) for r in by[name]] == [(None, None)] and reason in by[name][0].reason, (name, by[name])


def test_records_from_pages(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "none.pdf").write_bytes(b"")
    file = F.regexp_extract("file", "([a-z]+)[.]pdf$", 1)
    found = pdf.records(pdf.read(spark, str(tmp_path)), file, F.col("file")).collect()
    assert {r.record_id: [p.text for p in r.pages] for r in found} == {n[:-4]: p for n, p in PAGES.items()}


@pytest.mark.parametrize("data", [b"%PDF-1.4", b"%PDF-1.4\n1 0 obj", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages << /Kids [" + b"[" * 5000, plain().replace(b"/Kids", b"/Kidz"), plain().replace(b"endstream", b"")])
def test_damage_is_a_reason(spark, data):
    row = pdf.pages_of_files(spark.createDataFrame([("f", data, None)], "file string, content binary, reason string")).collect()
    assert all((r.reason is None) != (r.page is None) for r in row) and row


def test_codes_of_two_bytes_are_read_together():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <D83D> <0002> <DE42> endbfchar 1 beginbfrange <0003> <FFFF> <0003> endbfrange"
    made = lambda: pdf.Font(pdf.Document(b"%PDF-1.7\n4 0 obj << /Length " + str(len(cmap)).encode() + b" >>\nstream\n" + cmap + b"\nendstream endobj"), {"/Subtype": pdf.Name("/Type0"), "/ToUnicode": pdf.Ref(4)})
    font = made()
    assert font.text("harbour".encode("utf-16-be") * 1000) == "harbour" * 1000 and len(font.pairs) == 6
    for codes in ("ab\u0001\u0002c".encode("utf-16-be"), "x\U0001f642y\0".encode("utf-16-be"), b"\0a\xd8\x3d\0b", b"\0a\0", b"", "é數\n".encode("utf-16-be")):
        slow = made()
        size = lambda k, codes=codes: codes[k : k + 2]
        assert font.text(codes) == b"".join(slow._one(size(k)) for k in range(0, len(codes), 2)).decode("utf-16-be", "replace")
