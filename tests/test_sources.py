import io
import json
import tarfile

from pyspark.sql import functions as F

from grainmill.sources import tabular, webdataset


def shard(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_webdataset(spark, tmp_path):
    cap = lambda x: json.dumps({"tagging_caption": x}).encode()
    shard(tmp_path / "a.tar", [("000.jpg", b"j"), ("000.txt", b"t0"), ("000.json", cap("red cat")), ("001.png", b"p"), ("001.json", b"{broken")])
    shard(tmp_path / "sub" / "b.tar", [("in/002.jpg", b"j"), ("in/002.v2.txt", b"x"), ("in/002.json", cap(None)), ("000.jpg", b"k")])
    shard(tmp_path / "c.tar", [])
    (tmp_path / "d.tar").write_bytes(b"not a tar")
    rows = webdataset.members(spark, str(tmp_path))
    keys = webdataset.sample_keys(rows)
    assert {(r.sample_key, r.tar_path[-5:]) for r in keys.collect()} == {("000", "a.tar"), ("001", "a.tar"), ("in/002", "b.tar"), ("in/002.v2", "b.tar"), ("000", "b.tar")}
    full = webdataset.members(spark, str(tmp_path), payload="true").cache()
    got = {r["__key__"]: bytes(r.image) for r in webdataset.samples(full).where("image is not null and `__url__` like '%a.tar'").collect()}
    assert got == {"000": b"j", "001": b"p"}
    assert {(r.sample_key, r.caption) for r in webdataset.sidecars(full).collect()} == {("000", "red cat"), ("002", "")}
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.tar\n\n")
    assert webdataset.discover(listed=str(tmp_path / "list.txt")) == [f"{tmp_path}/a.tar"]
    assert len(webdataset.discover(str(tmp_path), most=2)) == 2


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sample_key,q\na,0.5\nb,x\n")
    assert dict(tabular.read_csv(spark, str(tmp_path / "s.csv")).dtypes) == {"sample_key": "string", "q": "string"}
    (tmp_path / "keys").write_text(" a \n\nb\na\n")
    assert {r.sample_key for r in tabular.read_keys(spark, str(tmp_path / "keys")).collect()} == {"a", "b"}
    (tmp_path / "log").write_text("x Diffusion loss 0.5\ny\nDiffusion loss 1.25 z\n")
    assert [r.value for r in tabular.read_log(spark, str(tmp_path / "log"), r"Diffusion loss\s+([\d.]+)").orderBy("place").collect()] == [0.5, 1.25]
    (tmp_path / "j").write_text('{"a": 1}\n{"a": 2}\n')
    assert tabular.read_splits(spark, {"train": str(tmp_path / "j")}, "a int")["train"].count() == 2
    df = tabular.rows(spark, {"sample_key": ["b", "a"], "count": [1, 2], "tar_path": ["t2", "t1"]})
    tabular.write_membership(df, str(tmp_path / "out"), {"name": "x"})
    assert tabular.exists(spark, str(tmp_path / "out/membership.parquet")) and not tabular.exists(spark, str(tmp_path / "none"))
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out/membership.parquet")).select("sample_key").collect()] == ["a", "b"]
    assert tabular.parse_config("name: run 1 # note\nK: 5\nmode: scan\nf: null\n") == {"name": "run 1", "K": 5, "mode": "scan", "f": None}
    assert tabular.parse_config('{"K": 5}') == {"K": 5}
    tabular.write_cache(df, str(tmp_path / "webdataset-x"), 3, 2, ["tar_path"])
    assert len(list((tmp_path / "webdataset-x").glob("part*"))) <= 4
    tabular.write_csv_summary(df, "tar_path", "count", str(tmp_path / "sum"))
    tabular.write_ordered_lines(df, F.col("sample_key"), str(tmp_path / "lines"), "sample_key")
    assert tabular.read_prefixed(spark, str(tmp_path / "webdataset-x"), "part").count() == 2
    assert tabular.read_files(spark, str(tmp_path), "keys").count() == 1
