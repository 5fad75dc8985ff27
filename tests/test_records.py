"""Structured arrays as sources: nested and flat records, archives, folders and odd files."""

import zipfile

import numpy as np
import pytest

from spotlake.sources import formats, records

SUB = [("itr", "<i4"), ("loc", "<f8", (3,)), ("efo", "<f4"), ("ok", "?")]
NESTED = np.dtype([("itr", SUB, (2,)), ("tid", "<i4"), ("tim", ">f8"), ("vld", "?"), ("gri", "u1")])
FLAT = np.dtype([("vld", "?"), ("fnl", "?"), ("itr", "<i4"), ("tid", "<u4"), ("tim", "<f8"), ("loc", "<f8", (3,)), ("dcr", "<f8", (2,)), ("bot", "?")])


def nested(n, seed=0):
    rng = np.random.default_rng(seed)
    a = np.zeros(n, NESTED)
    a["itr"]["loc"] = rng.random((n, 2, 3)) * 1e-6
    a["itr"]["efo"] = rng.random((n, 2))
    a["itr"]["itr"] = [0, 1]
    a["tid"], a["tim"], a["vld"], a["gri"] = np.arange(n) // 3, np.arange(n) * 0.5, np.arange(n) % 4 != 1, 200
    return a


def test_nested_records(spark, tmp_path):
    a = nested(records.BATCH + 7)  # more than one batch
    np.save(tmp_path / "m.npy", a)
    got = formats.load(spark, str(tmp_path / "m.npy")).orderBy("time_s").toPandas()
    want = a[a["vld"]]
    assert len(got) == len(want) and (got["gri"] == 200).all()
    np.testing.assert_array_equal(got["time_s"], want["tim"])
    np.testing.assert_array_equal(got["tid"], want["tid"])
    np.testing.assert_allclose(got["y_nm"], want["itr"]["loc"][:, 1, 1] * 1e9)
    np.testing.assert_array_equal(got["efo"].astype("f4"), want["itr"]["efo"][:, 1])
    every = formats.read_array_traces(spark, str(tmp_path / "m.npy"), every=True)
    assert every.count() == 2 * len(a) and every.where("final = 1").count() == len(want)


def test_archive_folder_and_layouts(spark, tmp_path):
    a, b = nested(10), nested(5, seed=1)
    for k, x in enumerate((a, b)):
        np.save(tmp_path / f"{k}.npy", x)
    with zipfile.ZipFile(tmp_path / "2.zip", "w") as z:
        z.write(tmp_path / "0.npy", "inside/0.npy")
        z.writestr("notes.txt", "nothing")
    assert records.read_arrays(spark, str(tmp_path)).count() == 25
    assert formats.load(spark, str(tmp_path / "2.zip")).count() == int(a["vld"].sum())
    np.save(tmp_path / "3.npy", np.zeros(3, FLAT))
    with pytest.raises(ValueError, match="different layouts"):
        records.read_arrays(spark, str(tmp_path))


def test_flat_records(spark, tmp_path):
    n = 12
    a = np.zeros(n, FLAT)
    a["vld"], a["fnl"], a["itr"], a["tid"], a["tim"] = np.arange(n) != 11, np.arange(n) % 4 == 3, np.arange(n) % 4, 2**32 - 1, np.arange(n)
    a["loc"], a["dcr"] = np.arange(3 * n).reshape(n, 3) * 1e-9, [[0.25, 0.75]] * n
    np.save(tmp_path / "f.npy", a)
    got = formats.load(spark, str(tmp_path / "f.npy")).orderBy("time_s").collect()
    assert [r["time_s"] for r in got] == [3.0, 7.0]
    assert [round(r["x_nm"], 6) for r in got] == [9.0, 21.0] and got[0]["dcr"] == 0.25 and got[0]["dcr2"] == 0.75 and got[0]["tid"] == 2**32 - 1
    every = formats.read_array_traces(spark, str(tmp_path / "f.npy"), every=True)
    assert every.count() == n and every.where("final = 1").count() == 2 and not {"fnl", "bot"} & set(every.columns)


def test_empty_and_refused_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", nested(0))
    assert formats.load(spark, str(tmp_path / "none.npy")).count() == 0
    np.save(tmp_path / "plain.npy", np.arange(4))
    with pytest.raises(Exception, match="no records"):
        records.read_arrays(spark, str(tmp_path / "plain.npy"))
    np.save(tmp_path / "pickled.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="no records"):
        records.read_arrays(spark, str(tmp_path / "pickled.npy"))
