import json
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark import cloudpickle

from leafscan import cli
from leafscan.config import DIALECTS, ContractError, Dialect, OutputError
from leafscan.operators import assemble, model
from leafscan.plans.read import Engine, document_texts
from leafscan.sources import files, png

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

CHARSET = " abc"


class Fake:
    """Says 'ab' for a line, and what else a test asks for."""

    def __init__(self, path=(2, 2, 0, 3), given=(1, 1, 160, 1024), made=(1, "sequence", 5), broken=False):
        self.path, self.given, self.made, self.broken = path, list(given), list(made), broken

    def get_inputs(self):
        return [SimpleNamespace(name="image", shape=self.given)]

    def get_outputs(self):
        return [SimpleNamespace(name="scores", shape=self.made)]

    def run(self, _, feed):
        assert feed["image"].shape == (1, 1, 160, 1024)
        out = np.zeros((1, len(self.path), 5), np.float32)
        out[0, np.arange(len(self.path)), list(self.path)] = 1
        if self.broken:
            out[0, 0, 0] = np.nan
        return [out]


def draw(lines=3):
    p = np.full((60 + 60 * lines, 400), 255, np.uint8)
    for i in range(lines):
        for j in range(10):
            p[30 + 60 * i : 70 + 60 * i, 60 + 20 * j : 72 + 20 * j] = 0
    return p


def folder(tmp_path):
    for name, n in (("a", 3), ("b", 1), ("empty", 0)):
        (tmp_path / f"{name}.png").write_bytes(png.encode(draw(n)))
    (tmp_path / "dark.png").write_bytes(png.encode(255 - draw(2)))
    (tmp_path / "bad.png").write_bytes(b"?")
    return str(tmp_path)


def test_pages_are_read(spark, tmp_path):
    where = folder(tmp_path)
    got = {r.file.rsplit("/", 1)[1]: r for r in Engine(spark, CHARSET, make_session=Fake).outcomes(where).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.png": "ab\nab\nab", "b.png": "ab", "empty.png": "ab", "dark.png": "ab\nab", "bad.png": None}
    assert not got["bad.png"].success and got["a.png"].success
    engine = Engine(spark, CHARSET, make_session=Fake)
    lines = engine.lines(files.pages(files.list_images(spark, where)))
    assert lines.where("path like '%/empty.png'").first().bbox.asDict() == {"x": 0, "y": 0, "w": 400, "h": 60}
    report = json.loads(engine.report(where).where("path like '%/a.png'").toJSON().first())
    assert report["success"] and report["pages"][0]["full_text"] == "ab\nab\nab" and len(report["pages"][0]["lines"]) == 3
    truth = spark.createDataFrame([(r.path, "ab\nab\nab") for r in lines.select("path").distinct().collect()], "path string, truth string")
    scores = {r.path.rsplit("/", 1)[1]: r.accuracy for r in engine.with_accuracy(where, truth).collect()}
    assert scores["a.png"] == 100 and 0 < scores["b.png"] < 100 and scores["bad.png"] == 0


def test_blank_lines_and_failed_lines(spark, tmp_path):
    where = folder(tmp_path)
    blank = lambda: Fake(path=(1,))
    text = lambda d, make: {r.path.rsplit("/", 1)[1]: r.text for r in Engine(spark, CHARSET, make_session=make, dialect=d).read_images(where).collect()}["a.png"]
    assert text(Dialect(), blank) == " \n \n " and text(DIALECTS["go"], blank) == ""
    broken = lambda: Fake(broken=True)
    assert text(DIALECTS["go"], broken) == ""
    with pytest.raises(Exception, match="OutputError"):
        text(Dialect(), broken)
    with pytest.raises(Exception, match="ContractError"):
        text(DIALECTS["go"], lambda: Fake(made=(1, "s", 9)))


@pytest.mark.parametrize("fake, charset", [(Fake(), ""), (Fake(), "ab"), (Fake(given=(1, 1, 100, 1024)), CHARSET), (Fake(given=(1, 160, 1024)), CHARSET), (Fake(made=(1, 5)), CHARSET)])
def test_broken_contracts(fake, charset):
    with pytest.raises(ContractError):
        model.check_contract(fake, charset)


def test_contract_with_free_axes():
    assert model.check_contract(Fake(given=("n", 1, "h", "w"), made=(1, "s", "c")), CHARSET) is None
    assert model.input_size(Fake(given=("n", 1, "h", 512))) == (160, 512)
    assert model.static(True) is None and model.static("x") is None and model.static(7) == 7


def test_scores_and_decoding():
    for bad in (np.zeros((4, 5)), np.zeros((1, 0, 5)), np.zeros((2, 3, 5)), np.zeros((1, 3, 4)), np.full((1, 3, 5), np.inf), np.full((1, 3, 5), -np.inf), np.full((1, 3, 5), np.nan)):
        with pytest.raises(OutputError):
            model.check_scores(bad, 5)
    one = lambda path, n: np.eye(n)[list(path)]
    assert model.decode(one((1, 1, 0, 1, 2, 3), 4), "abc") == "aabc"
    assert model.decode(one((2, 2, 2, 3, 3), 5), " abc") == "ab"
    assert model.decode(one((2, 0, 2), 5), " abc") == "aa" and model.decode(one((1, 2), 5), " abc") == " a" and model.decode(one((0, 0, 0), 5), " abc") == ""
    big = np.sin(0.37 * np.arange(128 * 277)).reshape(1, 128, 277)
    assert model.decode(model.check_scores(big, 277), "x" * 276)
    with pytest.raises(OutputError):
        model.decode(one((4,), 5), "abc")


def test_wide_lines_are_tiled():
    reader = model.Reader(Fake, CHARSET, Dialect())
    wide = np.full((40, 1200), 255, np.uint8)
    wide[10:30, ::3] = 0
    n = len(model.kernels.tiles(wide))
    assert n > 1 and reader.line(wide) == "ab" * n and model.Reader(Fake, CHARSET, DIALECTS["js"]).line(wide) == "ab"


def test_documents_tiles_and_boxes(spark):
    pages = spark.createDataFrame([("d", 10, "z"), ("d", 2, "a")], "path string, page_no int, text string")
    assert document_texts(pages).first().pages == ["a", "z"]
    t = spark.createDataFrame([(1, 0, "x", 100, 40, 254, 60), (1, 1, None, 354, 40, 255, 60), (1, 2, "y", 609, 40, 255, 60), (1, 3, "z", 864, 40, 136, 60)], "k int, tile_no int, text string, x int, y int, w int, h int")
    assert assemble.line_text(t, "k").first().text == "xyz"
    assert assemble.union_box(t, "k").first()[1:] == (100, 40, 900, 60)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    where = folder(tmp_path / "in")
    (tmp_path / "chars.txt").write_text(CHARSET + "\n")
    args = ["--charset", str(tmp_path / "chars.txt")]
    assert cli.main(["batch", where, *args, "--format", "json"], spark, Fake) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["file"].rsplit("/", 1)[1] for r in rows] == ["a.png", "b.png", "bad.png", "dark.png", "empty.png"]
    assert cli.main(["image", where, *args, "--output", str(tmp_path / "out")], spark, Fake) == 0
    assert "ab\nab" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert cli.main(["runtime"]) == 0


def test_stream_of_files(spark, tmp_path):
    from leafscan.streaming.pages import line_stream

    (tmp_path / "in").mkdir()
    where = folder(tmp_path / "in")
    q = line_stream(Engine(spark, CHARSET, make_session=Fake), where).writeStream.format("memory").queryName("lines_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("lines_seen").where("text = 'ab'").count() == 7
