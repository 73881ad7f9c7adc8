"""Files that are broken, laid out or many: PDF spans, mended XML, one scan for all formats."""

import random
import zlib

import pytest

from tessera.sources import pdf
from tessera.sources import sections as S


def pdf_file(pages, fonts=("Helvetica", "Helvetica-Bold"), flate=True, packed=False, encrypt=False, broken=False):
    """A file whose pages are lists of (font number, size, text)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = [10 + 2 * i for i in range(len(pages))]
    fonts_at = {f"F{i}": 3 + i for i in range(len(fonts))}
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << %s >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids), b" ".join(b"/%s %d 0 R" % (k.encode(), v) for k, v in fonts_at.items()))
    for (_, at), name in zip(fonts_at.items(), fonts, strict=True):
        objects[at] = b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name.encode()
    streams = {}
    for k, rows in zip(kids, pages, strict=True):
        out = b"BT 1 0 0 1 50 750 Tm 14 TL\n"
        for font, size, text in rows:
            shown = text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            out += b"/F%d %s Tf (%s) Tj T*\n" % (font, str(size).encode(), shown)
        out += b"ET"
        objects[k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (k + 1)
        streams[k + 1] = (b"/Filter /FlateDecode ", zlib.compress(out)) if flate else (b"", out)
    data, where = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    for n, (head, raw) in streams.items():
        where[n] = len(data)
        data += b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, head, len(raw), raw)
    trailer = b"/Root 1 0 R" + (b" /Encrypt << /Filter /Standard >>" if encrypt else b"")
    if packed:  # objects within a stream, cross references in another, with a predictor
        body, index = b"", []
        for n, x in objects.items():
            index.append((n, len(body)))
            body += x + b" "
        head = b" ".join(b"%d %d" % x for x in index) + b" "
        raw = zlib.compress(head + body)
        where[98] = len(data)
        data += b"98 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(index), len(head), len(raw), raw)
        rows = [(0, 0, 0)] * 100
        for n, at in where.items():
            rows[n] = (1, at, 0)
        for i, (n, _) in enumerate(index):
            rows[n] = (2, 98, i)
        start = len(data)
        rows[99] = (1, start, 0)
        table, above = b"", bytes(4)
        for kind, a, b in rows:
            row = bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
            table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
            above = row
        raw = zlib.compress(table)
        data += b"99 0 obj\n<< /Type /XRef /Size 100 /W [1 2 1] %s /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (trailer, len(raw), raw)
    else:
        for n, x in objects.items():
            where[n] = len(data)
            data += b"%d 0 obj\n%s\nendobj\n" % (n, x)
        start = len(data)
        data += b"xref\n0 1\n0000000000 65535 f \n"
        for n, at in sorted(where.items()):
            data += b"%d 1\n%010d 00000 n \n" % (n, at)
        data += b"trailer\n<< /Size 100 %s >>\n" % trailer
    data += b"startxref\n%d\n%%%%EOF\n" % (start + (7 if broken else 0))
    return bytes(data)


PAGES = [[(1, 18, "A heading of some length"), (0, 10, "First (line) of \\ text, naïve café"), (0, 10.5, "More – “quoted” €")], [(0, 10, "  padded  "), (0, 10, "   ")]]
WANT = [(1, 1, 18.0, 16, "A heading of some length"), (1, 2, 10.0, 0, "First (line) of \\ text, naïve café"), (1, 3, 10.5, 0, "More – “quoted” €"), (2, 1, 10.0, 0, "padded")]


@pytest.mark.parametrize("form", [{}, {"flate": False}, {"packed": True}, {"broken": True}, {"broken": True, "packed": True}])
def test_spans_of_pdf_files_equal_what_was_written(form):
    assert pdf.spans(pdf_file(PAGES, **form)) == WANT


def test_random_pdf_files():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc(é)\\") for _ in range(rng.randrange(1, 8)))
    for _ in range(40):
        pages = [[(rng.randrange(2), rng.choice([8, 10, 12.5]), " ".join(word() for _ in range(rng.randrange(1, 6)))) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 4))]
        want = [(p, i, float(s), 16 * f, t) for p, rows in enumerate(pages, 1) for i, (f, s, t) in enumerate(rows, 1)]
        assert pdf.spans(pdf_file(pages, packed=rng.random() < 0.5, flate=rng.random() < 0.5)) == want


def test_operators_of_text():
    content = b"""q 2 0 0 2 0 0 cm BT /F0 5 Tf 10 10 Td [(Ker) -20 (ned) -400 (apart)] TJ 0 -8 Td (next) Tj ET Q
    BT /F0 10 Tf 1 0 0 1 5 500 Tm (same) Tj 1 0 0 1 60 500 Tm (line) Tj ET BI /W 1 ID \x00(junk) Tj EI BT /F1 9 Tf <48 65 6C6C6f> Tj 1 2 (quoted) " ET /Fm Do (no font) Tj"""
    form = b"BT /F0 7 Tf (in a form) Tj ET"
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 2 0 R 3 0 R]>>endobj 3 0 obj<</Type/Page/Contents[4 0 R]/Resources<</Font<</F0 5 0 R/F1 6 0 R>>/XObject<</Fm 7 0 R>>>>>>endobj "
    data += b"4 0 obj<</Length %d>>stream\n%s\nendstream endobj 5 0 obj<</Type/Font/Subtype/TrueType/BaseFont/X#2DItalic>>endobj " % (len(content), content)
    data += b"6 0 obj<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding<</Differences[72/Eacute 101/uni4E1C/ffi]>>>>endobj 7 0 obj<</Subtype/Form/Length 999>>stream\n%s\nendstream endobj" % form
    got = pdf.spans(data)
    assert got == [
        (1, 1, 10.0, 2, "Kerned apart"), (1, 2, 10.0, 2, "next"), (1, 3, 10.0, 2, "same line"), (1, 4, 9.0, 8, "É东llo"), (1, 5, 9.0, 8, "quot东d"),
        (1, 6, 7.0, 2, "in a form"), (1, 7, 9.0, 8, "no ffiont"),
    ] + [(2, i, *x[2:]) for i, x in enumerate(got[:7], 1)]  # the page stands in the tree twice


def test_wide_fonts_and_filters():
    content = b"BT /F0 10 Tf <00410042F000> Tj ET"
    hexed = b"<" + content.hex().encode() + b">"
    cmap = b"2 beginbfchar <0041> <6771> <F000> <00660069> endbfchar 1 beginbfrange <0042> <0043> <4EAC> endbfrange"
    data = b"%PDF-1.7\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Kids[3 0 R]>>endobj\n3 0 obj<</Contents 4 0 R/Resources<</Font<</F0 5 0 R>>>>>>endobj\n"
    data += b"4 0 obj<</Filter[/ASCIIHexDecode]/Length %d>>stream\n%s\nendstream endobj\n5 0 obj<</Subtype/Type0/BaseFont/Z/DescendantFonts[<</DW 500/W[65[1000]66 70 900]>>]/ToUnicode 6 0 R>>endobj\n" % (len(hexed) - 1, hexed[1:])
    data += b"6 0 obj<</Length %d>>stream\n%s\nendstream endobj trailer<</Root 1 0 R>>" % (len(cmap), cmap)
    assert pdf.spans(data) == [(1, 1, 10.0, 0, "東京fi")]


def test_encrypted_damaged_and_empty_pdf_files():
    for raw in (pdf_file(PAGES, encrypt=True), pdf_file(PAGES, encrypt=True, packed=True), b"", b"plain text"):
        with pytest.raises(ValueError):
            pdf.spans(raw)
    assert pdf.spans(pdf_file([])) == [] and pdf.spans(b"%PDF-1.4 nothing in it") == []
    whole = pdf_file(PAGES, flate=False)
    rng = random.Random(8)
    for _ in range(150):  # damage may cost spans, but ends in spans or a ValueError
        raw = bytearray(whole[: rng.randrange(20, len(whole))] if rng.random() < 0.4 else whole)
        for _ in range(rng.randrange(1, 12)):
            raw[rng.randrange(10, len(raw))] = rng.randrange(256)
        try:
            assert all(len(x) == 5 for x in pdf.spans(bytes(raw)))
        except ValueError:
            pass


def test_broken_xml_gives_the_sections_behind_the_break():
    good = '<m><p name="N"><q>leaf &amp; more</q></p><r><s id="i">two</s></r></m>'
    assert S.xml_sections(good.encode()) == [(1, "xml:p", "[p] name=N\n[q] leaf & more"), (2, "xml:r", "[s:i] two")]
    for broken in (
        '<m><p name="N"><q>leaf & more</p><r><s id="i">two</s></r></m>', '<m><p name=N><q>leaf &amp; more</x></q></p><r><s id="i">two</s></r>',
        '<m>\n<p name="N"><q>leaf & more</q></p></z><r><s id=\'i\'>two', '<?xml version="1.0"?><!DOCTYPE m [<!ENTITY a "b">]><m><p name="N"><q><![CDATA[leaf & more]]></q></p><!-- > --><r><s id="i">two</s></m>',
        '<m><p name="N"><q>leaf & more</q></p></m><r><s id="i">two</s></r>',
    ):
        assert S.xml_sections(broken.encode()) == S.xml_sections(good.encode()), broken
    assert S.xml_sections('<?xml version="1.0" encoding="latin-1"?><m><p><q>é & è</q></p>'.encode("latin-1")) == [(1, "xml:p", "[q] é & è")]
    assert S.xml_sections(b"") == [] and S.xml_sections(b"no tags & nothing") == [] and S.xml_sections(b"<") == []
    assert [r for _, r, _ in S.xml_sections(b'<x:m xmlns:x="u"><x:p><y:q y:name="k">t</y:q></x:p>')] == ["xml:p"]


def test_a_folder_is_scanned_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.txt").write_text("Plain words of a text.\n")
        (tmp_path / f"x{i}.xml").write_text("<m><p><q>leaf</p></m>")
        (tmp_path / f"d{i}.puml").write_text("class Account {\n  balance\n}\n")
        (tmp_path / f"j{i}.json").write_text('{"k": 1}')
        rows = [[(0, 20, f"Heading number {k} of file"), *[(0, 10, f"line {j} of it") for j in range(6)]] for k in range(4)]
        (tmp_path / f"p{i}.PDF").write_bytes(pdf_file(rows, packed=i == 1))
    (tmp_path / "locked.pdf").write_bytes(pdf_file(PAGES, encrypt=True))
    (tmp_path / "other.bin").write_bytes(b"x" * 1000)
    registry = S.LoaderRegistry()
    plan = registry.parsed(S.files(spark, str(tmp_path), "srs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") == 1
    rows = registry.read(spark, str(tmp_path), "srs").collect()
    assert [(r["source_id"], r["error"]) for r in rows if r["error"]] == [("locked", "ValueError: PDF is encrypted")]
    by = {}
    for r in rows:
        if r["error"] is None:
            by.setdefault(r["source_id"], []).append((r["section_id"], r["section_ref"], r["text"]))
    assert len(by) == 15
    for i in range(3):
        assert sorted(by[f"p{i}"])[1] == (2, "Heading number 1 of file (p.2)", " \n".join(f"line {j} of it" for j in range(6)).replace(" \n", "\n"))
    assert registry.load_file(spark, str(tmp_path / "p0.PDF"), "srs").count() == 4
    with pytest.raises(ValueError, match="encrypted"):
        registry.load_file(spark, str(tmp_path / "locked.pdf"), "srs")


def test_small_files_share_batches(spark):
    rows = spark.createDataFrame([(f"d{i}", "srs", "xml", f"<m><a>{i}</a></m>".encode() if i % 50 else b"") for i in range(400)], "source_id string, artifact_type string, ext string, content binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = S.LoaderRegistry().parsed(rows).select("source_id", "text").mapInPandas(lambda batches: (b.head(1).assign(n=len(b)) for b in batches), "source_id string, text string, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["n"] for r in got) == 392 and len(got) == 1  # a batch a file before


def test_a_long_string_is_measured_once_for_each_string(monkeypatch):
    calls = []
    times = pdf._times
    monkeypatch.setattr(pdf, "_times", lambda m, n: calls.append(1) or times(m, n))
    head = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Kids [3 0 R]>> endobj\n3 0 obj <</Type /Page /Contents 6 0 R /Resources <</Font <</F1 4 0 R>>>>>> endobj\n4 0 obj <</Type /Font /Subtype /Type1 /BaseFont /F>> endobj\n"
    body = b"BT /F1 10 Tf 40 800 Td (" + b"a word " * 500 + b") Tj 5 Ts (up) Tj 0 Ts ( on) Tj ET"
    raw = head + b"6 0 obj <</Length %d>> stream\n%b\nendstream endobj\ntrailer <</Root 1 0 R>>" % (len(body), body)
    found = pdf.spans(raw)
    assert [x[-1] for x in found] == [("a word " * 500).strip(), "up on"] and len(calls) < 60  # some 14,000 before


def test_headings_of_a_source_are_counted_in_many_tasks(spark):
    import re

    def spans(source, n, sizes, every):
        return [(source, "srs", i // 7, i % 7, sizes[i % len(sizes)], 16 if every and i % every == 3 else 0, f"{source} text of span {i}" if i % 5 else " ") for i in range(n)]

    rows = spans("doc", 400, [10.0], 20) + spans("deck", 60, [10.0, 20.0], 0) + spans("plain", 60, [10.0], 0)
    frame = spark.createDataFrame(rows, "source_id string, artifact_type string, page int, pos int, size double, flags int, text string").repartition(7)
    out = S.span_sections(frame)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(source_id#\d+, (page|block)#", plan)
    got = {(r["source_id"], r["section_id"]): (r["section_ref"], r["text"]) for r in out.collect()}
    want, block, heads = {}, [], ("Preamble", 1)
    for _, _, page, _, _, flags, text in [*spans("doc", 400, [10.0], 20), (None, None, 0, 0, 0, 16, "x" * 20)]:
        if flags and 15 <= len(text) <= 150:
            if body := "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", " \n".join(block)).split("\n")).strip():
                want["doc", len(want) + 1] = (f"{heads[0]} (p.{heads[1]})", body)
            block, heads = [], (text, page)
        else:
            block.append(text)
    assert {k: v for k, v in got.items() if k[0] == "doc"} == want and len(want) > 10
    assert {k for k in got if k[0] != "doc"} == {(s, p) for s in ("deck", "plain") for p in range(9)} and got["deck", 0][0] == "page 0"
