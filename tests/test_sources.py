import struct
import sys

import numpy as np
import pytest

from leafscan.config import ContractError
from leafscan.operators import kernels
from leafscan.sources import exif, files, png


def upright():
    g = np.full((32, 64), 255, np.uint8)
    for a, b, c, d in ((4, 28, 4, 8), (4, 8, 4, 24), (14, 18, 4, 16), (20, 28, 32, 36), (4, 12, 48, 60), (24, 28, 44, 60)):
        g[a:b, c:d] = 24
    return g


def block(tag, order="<", kind=3):
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIHHHI", 42, 8, 1, 0x0112, kind, 1) + struct.pack(order + ("HH" if kind == 3 else "I"), *((tag, 0) if kind == 3 else (tag,)))


INVERSE = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}


@pytest.mark.parametrize("tag", range(1, 9))
def test_orientations_come_back_upright(tag):
    stored = kernels.orient(upright(), INVERSE[tag])
    data = png.encode(stored, extra=png.chunk(b"eXIf", block(tag, "<" if tag % 2 else ">")))
    assert exif.orientation(data) == tag
    assert (files.decode_page(data) == upright()).all()


def test_jpeg_tag_and_malformed_blocks():
    def jpeg(body):
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"

    assert exif.orientation(jpeg(b"Exif\0\0" + block(6))) == 6 and exif.orientation(jpeg(b"Exif\0\0" + block(8, ">", 4))) == 8
    far = bytearray(block(6))
    far[4:8] = struct.pack("<I", 9999)
    for bad in (None, b"", b"\xff\xd8", jpeg(b"Exif\0\0II"), jpeg(b"Exif\0\0" + bytes(far)), jpeg(b"Exif\0\0" + block(9)), png.SIGNATURE + struct.pack(">I", 1 << 30) + b"eXIf"):
        assert exif.orientation(bad) == 1
    late = png.encode(upright())
    assert exif.orientation(late + png.chunk(b"eXIf", block(6))) == 1


def test_transparency_is_paper():
    rgba = np.zeros((32, 48, 4), np.uint8)
    for a, b, c, d in ((6, 26, 6, 10), (6, 10, 6, 30), (16, 20, 6, 22)):
        rgba[a:b, c:d] = (24, 24, 24, 255)
    rgba[6:26, 40:44] = (0, 0, 0, 128)
    g = files.decode_page(png.encode(rgba))
    assert g[0, 0] == 255 and g[8, 8] == 24 and abs(int(g[10, 41]) - 127) <= 1
    opaque = np.dstack([upright()] * 3 + [np.full((32, 64), 255, np.uint8)])
    assert (files.decode_page(png.encode(opaque)) == upright()).all()
    ga = np.dstack([np.zeros((4, 4), np.uint8), np.zeros((4, 4), np.uint8)])
    assert (files.decode_page(png.encode(ga)) == 255).all()


def test_sixteen_bits_keep_contrast():
    wide = np.array([[60000, 6000]], np.uint16)
    assert files.decode_page(png.encode(wide, depth=16)).tolist() == [[233, 23]]


def test_filters_and_small_depths():
    import zlib

    g = np.arange(48, dtype=np.uint8).reshape(6, 8) * 5
    raw = bytearray()
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        raw.append(kind)
        for x in range(8):
            left = int(g[y, x - 1]) if x else 0
            up = int(g[y - 1, x]) if y else 0
            corner = int(g[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            raw.append((int(g[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
    head = png.chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0))
    assert (png.decode(png.SIGNATURE + head + png.chunk(b"IDAT", zlib.compress(bytes(raw))))[..., 0] == g).all()
    bits = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 1, 0, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"\0\xa0"))
    assert png.decode(bits)[..., 0].tolist() == [[255, 0, 255]]


def test_listing_and_bad_files(spark, tmp_path):
    (tmp_path / "b.PNG").write_bytes(png.encode(upright()))
    (tmp_path / "a.png").write_bytes(b"not a picture")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(png.encode(upright()))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.pages(files.list_images(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.png", "b.PNG"}
    assert rows["a.png"].error and rows["a.png"].grey is None
    assert (rows["b.PNG"].width, rows["b.PNG"].height, rows["b.PNG"].error) == (64, 32, None)
    from leafscan.config import DIALECTS

    assert files.list_images(spark, str(tmp_path), DIALECTS["go"]).count() == 1


def test_labels_charset_and_artifact(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\tone two\nbroken\nb\t\nc\tx\ty\n")
    assert {(r.name, r.text) for r in files.labelled_lines(spark, str(tmp_path / "l.txt")).collect()} == {("a", "one two"), ("b", ""), ("c", "x\ty")}
    (tmp_path / "c.txt").write_text(" abc\r\n")
    assert files.read_charset(spark, str(tmp_path / "c.txt")) == " abc"
    import hashlib

    good = hashlib.sha256(b" abc\r\n").hexdigest()
    assert files.verify_artifact(str(tmp_path / "c.txt"), good, 6)
    for digest, size in (("0" * 64, None), (good, 7)):
        with pytest.raises(ContractError):
            files.verify_artifact(str(tmp_path / "c.txt"), digest, size)


def test_pdf_pages(spark, tmp_path):
    assert files.page_number("page-010.png") == 10 and sorted(["p-10.png", "p-2.png"], key=files.page_number)[0] == "p-2.png"
    # a stand-in for the tool: as many pages as the file has letters p
    tool = tmp_path / "rasterise"
    (tmp_path / "p.png").write_bytes(png.encode(upright()))
    tool.write_text(f"""#!{sys.executable}
import shutil, sys
data = open(sys.argv[-2], "rb").read()
if data.startswith(b"bad"):
    sys.exit("no PDF")
for i in range(data.count(b"p")):
    shutil.copy({str(tmp_path / "p.png")!r}, f"{{sys.argv[-1]}}-{{i + 1:02}}.png")
""")
    tool.chmod(0o755)
    pdf = spark.createDataFrame([("a.pdf", b"ppp"), ("b.pdf", b"bad"), ("c.pdf", b"-")], "path string, content binary")
    got = sorted(files.pages(files.pdf_pages(pdf, tool=str(tool))).collect(), key=lambda r: (r.path, r.page_no))
    assert [(r.path, r.page_no, r.width) for r in got] == [("a.pdf", 1, 64), ("a.pdf", 2, 64), ("a.pdf", 3, 64), ("b.pdf", 1, None), ("c.pdf", 1, None)]
    assert [r.error for r in got] == [None, None, None, "PDF: no PDF", "PDF: it has no page"]
