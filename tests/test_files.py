"""Prefixes of files, files that are equal, and copies that all arrive or none."""

from __future__ import annotations

from pathlib import Path

import pytest
from galeria.sources import files as FI
from galeria.sources.folders import files, opened


def test_prefixes_of_the_tables_own_files(spark, small):
    want = {str(p): p for p in Path(small).rglob("*.parquet") if p.is_file()}
    rows = FI.prefixes(spark, small, 1000, ".parquet").collect()
    assert {r["path"] for r in rows} == set(want)
    for r in rows:
        body = want[r["path"]].read_bytes()
        assert r["length"] == len(body) and bytes(r["prefix"]) == body[:1000]


def test_no_more_than_the_prefix_is_read(tmp_path, monkeypatch):
    (tmp_path / "big").write_bytes(bytes(range(256)) * 40_000)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    reader, read = FI.PrefixReader({"path": str(tmp_path), "bytes": "4096"}), []

    class Counted:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            stream = self.system.open_input_file(path)
            class Stream:
                def __enter__(self):
                    return self

                def __exit__(self, *e):
                    read.append(stream.tell())
                    stream.close()

                def read(self, n):
                    return stream.read(n)

            return Stream()

    monkeypatch.setattr(FI, "opened", lambda path: (Counted(opened(path)[0]), path))
    part = FI.Paths([(str(tmp_path / "big"), 10_240_000), (str(tmp_path / "empty"), 0)])
    got = [b.to_pylist()[0] for b in reader.read(part)]
    assert [len(r["prefix"]) for r in got] == [4096, 0] and read == [4096, 0]
    monkeypatch.undo()
    assert [p for part in reader.partitions() for p, _ in part.paths] == [str(tmp_path / "big"), str(tmp_path / "empty")]


def test_equal_files(spark, tmp_path):
    bodies = {"a": b"x" * 50, "b": b"x" * 50, "c/d": b"x" * 49 + b"y", "e": b"12345", "f": b"12345", "g": b"12346", "h": b"", "i": b"", "j": b"alone"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = FI.duplicate_files(spark, str(tmp_path), 10).collect()
    assert sorted((r["length"], r["n"], r["first_path"].rsplit("/", 1)[1], r["reclaimable"]) for r in rows) == [(0, 2, "h", 0), (5, 2, "e", 5), (50, 2, "a", 50)]
    assert FI.duplicate_files(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture()
def sources(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / f"in/{i}.bin").write_bytes(bytes([i]) * (i * 1000))
    return tmp_path


def frame(spark, root, n, bad=()):
    rows = [(f"{root}/in/{i}.bin" if i not in bad else f"{root}/in/missing", f"{'a' if i % 2 else 'b'}/{i}.bin") for i in range(n)]
    return spark.createDataFrame(rows, "source string, target string").repartition(4)


def held(path):
    system, _ = opened(path)
    return {i.path[len(path) + 1 :]: i.size for i in files(system, path)}, sorted(p.name for p in Path(path).rglob("*") if p.name.startswith("_staging"))


def test_copies_arrive_once(spark, sources):
    FI.copy_files(frame(spark, sources, 12), f"{sources}/out")
    want = {f"{'a' if i % 2 else 'b'}/{i}.bin": i * 1000 for i in range(12)}
    assert held(f"{sources}/out") == (want, [])
    before = {p: p.stat().st_mtime_ns for p in Path(f"{sources}/out").rglob("*.bin")}
    FI.copy_files(frame(spark, sources, 12), f"{sources}/out")
    assert {p: p.stat().st_mtime_ns for p in Path(f"{sources}/out").rglob("*.bin")} == before
    (sources / "in/3.bin").write_bytes(b"changed")
    FI.copy_files(frame(spark, sources, 12), f"{sources}/out")
    assert (sources / "out/a/3.bin").read_bytes() == b"changed"


def test_a_failing_task_leaves_no_file(spark, sources):
    with pytest.raises(Exception, match="missing"):
        FI.copy_files(frame(spark, sources, 12, bad={7}), f"{sources}/out")
    assert held(f"{sources}/out") == ({}, [])
    FI.copy_files(frame(spark, sources, 12), f"{sources}/out")
    assert len(held(f"{sources}/out")[0]) == 12


def test_a_commit_that_fails_takes_back_what_it_moved(sources):
    writer = FI.CopyWriter(f"{sources}/out")
    done = writer.write(iter([{"source": f"{sources}/in/{i}.bin", "target": t} for i, t in ((1, "x/1"), (2, "x/2"), (3, "x/1/3"))]))
    assert len(done.staged) == 3 and done.there == 0
    with pytest.raises(OSError):
        writer.commit([done])
    assert held(f"{sources}/out") == ({}, [])
