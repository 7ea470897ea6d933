import os

import pytest

from conftest import rows
from lineweave import engine, spec
from lineweave.sources.lines import discover, read_from_offsets, read_lines, text_files


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return folder


def test_a_file_over_several_splits(spark, tmp_path):
    want = [f"line {k} " + "x" * (k % 97) for k in range(1, 4001)]
    (tmp_path / "big.txt").write_bytes("\n".join(want).encode())
    (tmp_path / "small.txt").write_bytes(b"a\r\nb\n\nc\rd\n")
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbfone\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_lines(spark, str(tmp_path), keep_ends=True)
        assert df.select("source").rdd.getNumPartitions() >= 4
        got = rows(df, "source", "line_no")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(n, v) for s, n, v, _ in got if s.endswith("big.txt")] == list(enumerate(want, 1))
    assert {(e, n == 4000) for s, n, _, e in got if s.endswith("big.txt")} == {("LF", False), ("NONE", True)}
    assert [(n, v, e) for s, n, v, e in got if s.endswith("small.txt")] == [(1, "a", "CRLF"), (2, "b", "LF"), (3, "", "LF"), (4, "c\rd", "LF")]
    assert [(v, e) for s, _, v, e in got if s.endswith("mark.txt")] == [("one", "LF"), ("two", "NONE")]


def test_line_ends_are_kept(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"a 1\r\nb 2\nc 3")
    p = spec.from_dict({"settings": {"preserve_line_endings": True}, "step": [{"type": "substitute", "pattern": "[0-9]", "replacement": "N"}]})
    lines = read_lines(spark, str(tmp_path), keep_ends=True)
    assert [tuple(r)[1:] for r in engine.run(p, lines).lines.orderBy("line_no").collect()] == [(1, "a N", "CRLF"), (2, "b N", "LF"), (3, "c N", "NONE")]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_reading_goes_on_from_offsets(spark, tmp_path, size):
    text = [f"line {k}" for k in range(1, 41)]
    path = str(tmp_path / "f.log")
    with open(path, "w") as f:
        f.write("\n".join(text) + "\n")
    other = str(tmp_path / "new.log")
    with open(other, "w") as f:
        f.write("only")
    at = len("\n".join(text[:10])) + 1
    state = spark.createDataFrame([(path, at, 10), ("gone", 5, 1)], "source string, byte_offset long, line_number long")
    got = rows(read_from_offsets(spark, [path, other], state, size), "source", "line_no")
    assert got == [(path, n, v) for n, v in enumerate(text, 1) if n > 10] + [(other, 1, "only")]


def test_binary_files(spark, tmp_path):
    write(tmp_path, a_dot_txt="plain", b_dot_bin=b"x\x00y", c_dot_txt=b"y" * 9000 + b"\x00", d_dot_txt="")
    paths = sorted(str(p) for p in tmp_path.iterdir())
    assert [os.path.basename(r[0]) for r in rows(text_files(spark, paths), "source")] == ["a.txt", "c.txt", "d.txt"]


def test_ignore_files_hold_below(tmp_path):
    write(
        tmp_path, _dot_gitignore="*.log\n/top.txt\nbuild/\n!keep.log\ndocs/*.tmp\n# note\n", a_dot_log="", keep_dot_log="", top_dot_txt="", sub__top_dot_txt="", sub__c_dot_log="", sub__keep_dot_log="", build__x_dot_txt="",
        sub__build__y_dot_txt="", docs__z_dot_tmp="", sub__docs__z_dot_tmp="", sub___dot_ignore="!c.log\n", sub__deep__c_dot_log="",
    )
    got = [os.path.relpath(f, tmp_path) for f in discover([str(tmp_path)])[0]]
    assert got == ["keep.log", "sub/c.log", "sub/keep.log", "sub/top.txt", "sub/deep/c.log", "sub/docs/z.tmp"]
    assert discover([str(tmp_path / "none")]) == ([], [f"{tmp_path / 'none'}: no such file or directory"])
