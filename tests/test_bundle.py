"""Folders committed by tasks."""

import json

import pytest
from pyspark.sql import functions as F

from molframe.errors import MolframeError
from molframe.sinks import bundle
from tests.test_prepare import dry, ff  # noqa: F401


@pytest.fixture(scope="module")
def small(dry):  # noqa: F811
    return dry.kept()


def test_folders_are_whole_refused_and_replaced(spark, small, tmp_path):
    reports = spark.createDataFrame([("one", 1, None), ("two", 2, "x")], "sid string, n int, note string")
    want = {(r.sid, r.file): r for r in bundle.texts(small).collect()}
    out = tmp_path / "out"
    folders = bundle.write_bundles(small, reports, out)
    assert folders == [out / "one", out / "two"] and sorted(x.name for x in out.iterdir()) == ["one", "two"]
    for sid in ("one", "two"):
        told = json.loads((out / sid / "manifest.json").read_text())
        assert told["output_sha256"] == {f: want[sid, f].sha256 for f in bundle.FILES}
        assert all((out / sid / f).read_text() == want[sid, f].text for f in bundle.FILES)
    assert "note" in json.loads((out / "one" / "manifest.json").read_text())
    (out / "two" / "system.gro").write_text("changed")
    (out / "one" / "manifest.json").unlink()
    with pytest.raises(MolframeError):
        bundle.write_bundles(small, reports, out)
    assert (out / "two" / "system.gro").read_text() == "changed" and not (out / "one" / "manifest.json").exists()
    bundle.write_bundles(small, reports, out, overwrite=True)
    assert (out / "two" / "system.gro").read_text() == want["two", "system.gro"].text and (out / "one" / "manifest.json").exists()


def test_two_attempts_leave_one_file(tmp_path):
    at, root = bundle._root(tmp_path)
    staged, place = tmp_path / "s", tmp_path / "p"
    staged.write_text("text")
    bundle._put(at, f"{root}/s", f"{root}/p", False)
    bundle._put(at, f"{root}/s", f"{root}/p", False)
    assert place.read_text() == "text" and not staged.exists()
    staged.write_text("other")
    with pytest.raises(MolframeError):
        bundle._put(at, f"{root}/s", f"{root}/p", False)
    assert place.read_text() == "text"
    bundle._put(at, f"{root}/s", f"{root}/p", True)
    assert place.read_text() == "other"
    place.unlink()
    with pytest.raises(MolframeError):
        bundle._put(at, f"{root}/s", f"{root}/p", True)


def test_an_attempt_that_ends_early_leaves_no_row(tmp_path):
    import pandas as pd

    rows = pd.DataFrame({"sid": ["a", "a", "b"], "file": ["f", "f", "f"], "text": ["1", "2", "3"]})

    def broken():
        yield rows
        raise OSError("lost")

    got = []
    with pytest.raises(OSError):
        for x in bundle._stage(str(tmp_path), "r")(broken()):
            got.append(x)
    assert [tuple(x.iloc[0, :2]) for x in got] == [("a", "f")]
    again = pd.concat(bundle._stage(str(tmp_path), "r")(iter([rows])))
    assert again["bytes"].tolist() == [4, 2] and len(set(again["path"]) & set(got[0]["path"])) == 0
    assert [open(p).read() for p in again["path"]] == ["1\n2\n", "3\n"]
