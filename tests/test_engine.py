"""Files, filters, reports, comparison, watching."""

import json
import os
import pickle
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from textloom.__main__ import config_of, main, parser
from textloom.errors import ConfigError, EngineError, FileReadError
from textloom.functions import metrics as M
from textloom.operators import compare, reports
from textloom.operators.stats import analyze_table, bounded, filter_stats, line_stats, totals
from textloom.plans import config as C
from textloom.plans.engine import Engine
from textloom.schema import FILE_STATS
from textloom.sources.files import Walker, extension, pack
from textloom.sources.ignore import Overrides, Rules
from textloom.sources.path_safety import SanitizeOptions, is_path_safe, sanitize_path
from textloom.sources.snapshot import read_snapshot, read_snapshot_lines, write_snapshot
from textloom.streaming.watch import fingerprint, on_change


@pytest.fixture
def tree(tmp_path):
    def put(path, data):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)

    put("a.rs", b"fn main() {\r\n    // x\r\n}\r\n")
    put("_u.py", b"# c\nx = 1\n")
    put(".h.py", b"x\n")
    put("sub/b|,.txt", b"one two\nthree")
    put("bin.dat", b"\0\1")
    put("sub/i.log", b"z")
    put("sub/keep.log", b"k\n")
    put("sub/.hid/x.c", b"int a;\n")
    put("README", b"\xff\xe3\x81\n")
    (tmp_path / ".git").mkdir()
    put(".gitignore", b"*.log\n!keep.log\n")
    return tmp_path


def names(root, filters=None, **options):
    return sorted(os.path.relpath(f.path, root) for f in Walker(C.WalkOptions(roots=[str(root)], **options), filters or C.FilterConfig()).files())


def test_walk(tree):
    usual = ["README", "_u.py", "a.rs", "bin.dat", "sub/b|,.txt", "sub/keep.log"]
    assert names(tree) == usual
    assert names(tree, git_ignore=False) == sorted([*usual, "sub/i.log"])
    assert {".h.py", "sub/.hid/x.c", ".gitignore"} < set(names(tree, hidden=True))
    assert names(tree, max_depth=1000) == usual
    assert names(tree, C.FilterConfig(include_patterns=["*.rs", "*.py"])) == [".h.py", "_u.py", "a.rs"]  # a glob that keeps a file shows it, hidden or not
    assert names(tree, C.FilterConfig(include_patterns=["sub/**"], exclude_patterns=["*.txt"])) == ["sub/.hid/x.c", "sub/i.log", "sub/keep.log"]
    assert names(tree, C.FilterConfig(exclude_patterns=["*.log"])) == [n for n in usual if not n.endswith(".log")]
    assert names(tree, override_exclude=["sub"]) == [n for n in usual if not n.startswith("sub")]
    assert names(tree, C.FilterConfig(allow_ext=[".RS", "py "])) == ["_u.py", "a.rs"]
    assert names(tree, C.FilterConfig(deny_ext=["rs", "log"])) == ["README", "_u.py", "bin.dat", "sub/b|,.txt"]
    assert names(tree, C.FilterConfig(min_size=10, max_size=13)) == ["_u.py", "sub/b|,.txt"]
    assert names(tree, C.FilterConfig(mtime_until=datetime(2000, 1, 1, tzinfo=timezone.utc))) == []
    assert names(tree, types=["rs"]) == ["a.rs"]
    assert names(tree / "missing") == []
    with pytest.raises(ConfigError):
        names("..")
    with pytest.raises(ConfigError):
        names(tree, max_depth=1)  # the root's own depth is held against it too
    with pytest.raises(ConfigError):
        names(tree, C.FilterConfig(include_patterns=["[a"]))


def test_links(tree):
    os.symlink(tree / "sub", tree / "link")
    assert not any(n.startswith("link") for n in names(tree))
    assert "link/keep.log" in names(tree, follow_links=True)
    with pytest.raises(ConfigError):
        names(tree / "link")


def test_rules():
    rules = Rules(["*.o", "/top", "dir/", "a/**/z", "!keep.o", "\\#x", "# no", "q?[ab]"])
    assert rules.decide("x/y.o", False) and rules.decide("keep.o", False) is False
    assert rules.decide("top", False) and rules.decide("s/top", False) is None
    assert rules.decide("s/dir", True) and rules.decide("s/dir", False) is None
    assert rules.decide("a/z", False) and rules.decide("a/b/c/z", False) and rules.decide("b/a/z", False) is None
    assert rules.decide("#x", False) and rules.decide("qxa", False) and rules.decide("qxc", False) is None
    kept = Overrides(["*.{rs,py}", "!x.py"])
    assert kept.decide("a.rs", False) is False and kept.decide("x.py", False) is True and kept.decide("a.c", False) is True and kept.decide("d", True) is None


def test_extension():
    assert [extension(n) for n in ("a.RS", "a.b.c", ".bashrc", "x", "a.", "..x")] == ["RS", "c", "", "", "", "x"]


def test_pack():
    files = [type("F", (), {"size": s, "path": str(i)})() for i, s in enumerate([100 << 20, 90 << 20, 1, 2, 3, 80 << 20])]
    bins = pack(files, 2)
    assert sum(map(len, bins)) == 6 and len(bins) == 3


def test_walk_by_folder(tmp_path, monkeypatch):
    """What holds for a folder is found out once for it, and partitions are small however long the paths are."""
    from textloom.sources import files as S

    deep = tmp_path.joinpath(*["folder"] * 15)
    deep.mkdir(parents=True)
    for i in range(500):
        (deep / f"{'skip_' * (i % 5 == 0)}d{i}.txt").write_text("x" * i)
    (deep / "caf\udce9.txt").write_text("é")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("skip_*\n/folder/**/d1.txt\nx{a,**}\n")
    calls, real = [], os.path.abspath
    monkeypatch.setattr(os.path, "abspath", lambda p: calls.append(p) or real(p))
    reader = S._Reader({"config": json.dumps({"walk": {"roots": [str(tmp_path)], "threads": 3}, "filter": {"mtime_since": None, "mtime_until": None}})})
    parts = reader.partitions()
    wanted = {str(deep / f"d{i}.txt"): i for i in range(500) if i % 5 and i != 1} | {str(deep / "caf\udce9.txt"): 2}
    assert len(calls) < 400 and len(parts) == 3
    assert sum(len(pickle.dumps(p)) for p in parts) < 40 * len(wanted)
    found = [f for p in parts for f in pickle.loads(pickle.dumps(p)).files]
    assert {f.path: f.size for f in found} == wanted and len(found) == len(wanted) and all(f.mtime == os.stat(f.path).st_mtime for f in found)


def test_path_safety(tmp_path):
    assert is_path_safe("a/b/../c") and not is_path_safe("a/../../secret") and not is_path_safe("..") and not is_path_safe("a\0b")
    inner = tmp_path / "in"
    inner.mkdir()
    assert sanitize_path(str(inner)).canonical == os.path.realpath(inner)
    os.symlink(inner, tmp_path / "l")
    with pytest.raises(ConfigError):
        sanitize_path(str(tmp_path / "l"))
    assert sanitize_path(str(tmp_path / "l"), SanitizeOptions(allow_symlinks=True)).was_symlink
    with pytest.raises(ConfigError):
        sanitize_path(str(tmp_path), SanitizeOptions(allowed_roots=[str(inner)]))
    with pytest.raises(ConfigError):
        sanitize_path(str(inner / "../in"), SanitizeOptions(allowed_roots=[str(tmp_path)]))
    with pytest.raises(ConfigError):
        sanitize_path("/a/b/c", SanitizeOptions(max_depth=2))
    with pytest.raises(EngineError):
        sanitize_path(str(tmp_path / "none"))


@pytest.mark.parametrize(("text", "value"), [("1K", 1024), ("1KB", 1024), ("1KiB", 1024), ("1k", 1024), ("1_000", 1000), (" 2 mb ", 2 << 20), ("3g", 3 << 30), ("1tib", 1 << 40), ("7", 7)])
def test_sizes(text, value):
    assert C.parse_size(text) == value


@pytest.mark.parametrize("text", ["", "b", "1b", "1.5k", "-1", "k", "1kk"])
def test_bad_sizes(text):
    with pytest.raises(ConfigError):
        C.parse_size(text)


def test_other_literals():
    assert C.parse_datetime("2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert C.parse_datetime("2024-01-02 03:04:05").tzinfo is not None and C.parse_datetime("2024-01-02").hour == 0
    for bad in ("2024-13-01", "yesterday", "2024-01-02T25:00:00Z"):
        with pytest.raises(ConfigError):
            C.parse_datetime(bad)
    assert C.parse_sort("lines:desc, NAME,, sloc:DESC,ext:Desc,size:up") == [("lines", True), ("name", False), ("sloc", True), ("ext", False), ("size", False)]
    assert C.parse_sort("") == []
    with pytest.raises(ConfigError):
        C.parse_sort("colour")
    assert C.parse_pair("a=b=c") == ("a", "b=c")
    with pytest.raises(ConfigError):
        C.parse_pair("ab")
    assert C.parse_bounded("512", 1, 512) == 512
    for bad in ("0", "513", "x", "-1"):
        with pytest.raises(ConfigError):
            C.parse_bounded(bad, 1, 512)


def test_config_needs():
    c = config_of(parser().parse_args(["--min-words", "0", "--sort", "sloc:desc", "--map-ext", "a=b", "--map-ext", "a=c", "--ext", "x,y", "--ext", "z"]))
    assert c.count_words and c.count_sloc and c.filter.map_ext == {"a": "c"} and c.filter.allow_ext == ["x", "y", "z"] and c.walk.roots == ["."]


def test_counts(spark):
    rows = [("",), ("a",), ("a\n",), ("a\n\n",), ("abc \nde \r\nfg ",), ("x\ry\r\n",), ("a　b\x1cc",), (None,)]
    df = analyze_table(spark.createDataFrame(rows, "t string"), "t", "txt")
    got = [tuple(r)[1:] for r in df.collect()]
    assert got == [(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 10, 3, 3), (1, 3, 2, 1), (1, 5, 2, 1), (None, None, None, None)]
    c = spark.createDataFrame([("x\ry\r\n",)], "t string").select(M.chars_by_ext(F.col("t"), "c"), M.chars_by_ext(F.col("t"), "txt"), M.chars_by_ext(F.col("t"), "c", newlines=True)).first()
    assert tuple(c) == (2, 3, 5)


def test_lines(spark):
    df = spark.createDataFrame([(1, "a b\r\n# c\n\nd = 1"), (2, ""), (3, None), (4, "x\n")], "id int, t string").withColumn("key", F.lit(0)).withColumn("code", F.lit(0))
    got = [tuple(r) for r in line_stats(df, "id", "t", "py").orderBy("key", "line").collect()]
    assert got == [(1, 0, 1, 3, 2), (1, 1, 0, 3, 2), (1, 2, 0, 0, 0), (1, 3, 1, 5, 3), (4, 0, 1, 1, 1)]


def test_native_and_machine_counts_agree(spark):
    from textloom.functions.analyzers import count_code

    texts = ["REM\n x\n\n rem a\n@rem b\n::c", "C x\n c\n ! y\n\nz", "-- a\n b -- c\n\n", "　; a\nb", "% a\n%\n\n", "' a\nREM b \n", "", "\n"]
    exts = ["bat", "f", "vhd", "el", "asm", "tex", "vb", "txt"]
    df = spark.createDataFrame([(t, e) for t in texts for e in exts], "t string, e string")
    for r in df.select("t", "e", M.code_count(F.col("t"), F.col("e")).alias("n")).collect():
        assert r.n == count_code(r.t, r.e), (r.t, r.e)


def test_python_runs_only_where_a_style_needs_it(spark):
    df = spark.createDataFrame([("x",)], "t string")
    plan = lambda c: df.select(c)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(M.code_count(F.col("t"), "txt")) and "ArrowEvalPython" in plan(M.code_count(F.col("t"), "py"))


def test_run(spark, tree):
    config = C.Config(walk=C.WalkOptions(roots=[str(tree)], threads=2), count_words=True, count_sloc=True)
    result = Engine(spark).run(config)
    rows = {r.name: r for r in result.stats.collect()}
    assert (rows["a.rs"].lines, rows["a.rs"].chars, rows["a.rs"].size, rows["a.rs"].sloc) == (3, 20, 26, 2)
    assert rows["bin.dat"].is_binary and rows["bin.dat"].lines == 0 and rows["bin.dat"].words is None and rows["bin.dat"].sloc is None
    assert (rows["README"].lines, rows["README"].chars, rows["README"].ext) == (1, 2, "")
    assert result.file_count() == 6 and not result.has_errors()
    few = Engine(spark).run(C.Config(walk=config.walk, filter=C.FilterConfig(min_words=2)))
    assert sorted(r.name for r in few.stats.collect()) == ["_u.py", "a.rs", "b|,.txt"]
    mapped = Engine(spark).run(C.Config(walk=config.walk, count_sloc=True, filter=C.FilterConfig(map_ext={"txt": "py"})))
    assert {r.name: r.sloc for r in mapped.stats.collect()}["b|,.txt"] == 2


def test_bounds_count_once(spark, tree):
    """Bounds on counts neither decode nor count a text again, whatever there are of them."""
    def told(filters):
        stats = Engine(spark).run(C.Config(walk=C.WalkOptions(roots=[str(tree)]), filter=filters, count_words=True)).stats
        plan = stats._jdf.queryExecution().optimizedPlan().toString()
        return sorted(r.name for r in stats.collect()), plan.count("makeValid"), plan.count("regexp_extract_all")

    assert told(C.FilterConfig(min_words=1, max_words=5, max_lines=2)) == (["README", "_u.py", "b|,.txt", "keep.log"], 1, 1)
    assert told(C.FilterConfig(min_words=1, condition="Words * 2 > lines AND words < 6 AND size > 3")) == (["README", "_u.py", "b|,.txt"], 1, 1)
    assert told(C.FilterConfig(max_words=5, min_lines=0))[0] == told(C.FilterConfig(max_words=5))[0]  # a binary file has no words
    # what isn't bounded is counted for the rows that stay, and a column of a count's name gives way
    f = C.FilterConfig(min_words=2, condition="LINES < 3")
    table = spark.createDataFrame([(1, "a b", "x"), (2, "a\nb\nc", "y"), (3, None, "z")], "id int, text string, words string")
    kept = filter_stats(analyze_table(table, "text", "py", first=bounded(f)), f)
    assert bounded(f) == {"words", "lines"} and kept.columns == ["id", "text", "words", "lines", "chars", "sloc"] and [tuple(r) for r in kept.collect()] == [(1, "a b", 2, 1, 3, 1)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.index("ArrowEvalPython") < plan.index("Filter") < plan.index("Generate")


def test_errors(spark, tree, monkeypatch):
    bad = C.Config(walk=C.WalkOptions(roots=["../../.."]))
    result = Engine(spark).run(bad)
    assert result.file_count() == 0 and result.errors.first().path == "<walk>"
    bad.strict = True
    with pytest.raises(ConfigError):
        Engine(spark).run(bad)
    files = spark.createDataFrame([("/x", 1, None, "", "x", None, "Failed to read file '/x': no")], "path string, size bigint, mtime timestamp, ext string, name string, content binary, error string")
    monkeypatch.setattr("textloom.plans.engine.read_files", lambda *_: files)
    assert Engine(spark).run(C.Config()).error_count() == 1
    with pytest.raises(FileReadError):
        Engine(spark).run(C.Config(strict=True))


def lines(spark, tree, *args):
    config = config_of(parser().parse_args([str(tree), *args]))
    return [x.replace(str(tree), "@") for x in reports.render(Engine(spark).run(config).stats, config)]


def test_reports(spark, tree):
    out = lines(spark, tree, "--sloc", "--words", "--walk-threads", "3")
    assert out[0] == "textloom v0.1.0 · parallel=3" and out[2] == "    LINES            SLOC        CHARACTERS     FILE"
    assert out[4:8] == ["        1               1               2      @/README", "        1               1               1      @/sub/keep.log", "        2               1               8      @/_u.py", "        2               2              12      @/sub/b|,.txt"]
    assert out[-3] == "        9               7              43      TOTAL (5 files)" and out[-1] == "[textloom] Completed: 5 files processed."
    assert lines(spark, tree, "--format", "csv", "--sort", "name:desc", "--total-row", "--ext", "txt,rs") == ["lines,chars,path", '2,12,"@/sub/b|,.txt"', "3,20,@/a.rs", "5,32,TOTAL"]
    assert lines(spark, tree, "--format", "tsv", "--words", "--ext", "txt") == ["lines\tchars\twords\tpath", "2\t12\t3\t@/sub/b|,.txt"]
    assert lines(spark, tree, "--format", "md", "--ext", "txt") == ["### File Statistics", "", "| Lines | Chars | File |", "|:---:|:---:|:---|", "| 2 | 12 | @/sub/b\\|,.txt |", ""]
    found = json.loads("\n".join(lines(spark, tree, "--format", "json", "--ext", "rs")))
    assert list(found[0]) == [f.name for f in FILE_STATS] and found[0]["words"] is None and found[0]["chars"] == 20
    assert lines(spark, tree, "--format", "json", "--ext", "none") == ["[]"]
    jsonl = [json.loads(x) for x in lines(spark, tree, "--format", "jsonl", "--words", "--ext", "rs,py")]
    assert [x["type"] for x in jsonl] == ["file", "file", "total"] and jsonl[-1]["files"] == 2 and list(jsonl[0]) == sorted(jsonl[0])
    assert lines(spark, tree, "--format", "yaml", "--ext", "rs")[:5] == ["- path: '@/a.rs'" if "'" in str(tree) else "- path: @/a.rs", "  lines: 3", "  chars: 20", "  words: null", "  sloc: null"]
    assert lines(spark, tree, "--top", "1", "--format", "csv", "--sort", "lines:desc")[1] == "3,20,@/a.rs"
    assert [json.loads(x)["files"] for x in lines(spark, tree, "--by", "ext", "--filter", "lines < 3")] == [1, 1, 1, 1]


def test_write_lines(spark, tree, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("written")
    config = config_of(parser().parse_args([str(tree), "--format", "csv"]))
    for fmt in ("csv", "md", "jsonl", "table", "yaml"):
        config = config_of(parser().parse_args([str(tree), "--format", fmt, "--sloc", "--total-row", "--sort", "lines:desc"]))
        stats = Engine(spark).run(config).stats
        reports.write_lines(stats, config, str(tmp_path / fmt))
        text = "".join(f.read_text() for f in sorted((tmp_path / fmt).glob("part-*")))
        assert text.rstrip("\n").split("\n") == "\n".join(reports.render(stats, config)).rstrip("\n").split("\n")
    config.format = "json"
    reports.write_lines(stats, config, str(tmp_path / "json"))
    assert [json.loads(r.value)["lines"] for r in spark.read.text(str(tmp_path / "json")).collect()] == [3, 2, 2, 1, 1]


def test_scalars_of_yaml(spark):
    names = ["plain/a.rs", "yes", "No", "12", "1.5e3", "-x", "a: b", "it's", "# x", "", "a b ", "tab\tx", 'q"x', "~", ".inf", "é", "x\n", "a-b_c+d"]
    wanted = ["plain/a.rs", "'yes'", "'No'", "'12'", "'1.5e3'", "'-x'", "'a: b'", "'it''s'", "'# x'", "''", "'a b '", '"tab\\tx"', "'q\"x'", "'~'", "'.inf'", "'é'", '"x\\n"', "a-b_c+d"]
    df = spark.createDataFrame([(n, 1, 1, None, None, 1, None, "", n, False) for n in names], FILE_STATS)
    got = [r.b.split("\n") for r in df.select(reports.yaml_block().alias("b")).collect()]
    assert [b[0] for b in got] == [f"- path: {w}" for w in wanted] and got[0][1:4] == ["  lines: 1", "  chars: 1", "  words: null"] and got[0][-1] == "  is_binary: false"


def test_files_are_read_once(spark, tree, capsys, monkeypatch):
    """A report's errors, rows and totals come from one read, whatever the files do meanwhile."""
    from textloom.operators import reports as R

    real = R.head_lines

    def changed(config):
        (tree / "a.rs").write_text("changed\n" * 50)
        return real(config)

    monkeypatch.setattr(R, "head_lines", changed)
    config = config_of(parser().parse_args([str(tree), "--format", "csv", "--ext", "rs", "--total-row"]))
    result = Engine(spark).run(config, once=True)
    assert not result.has_errors()
    assert [x.split(",")[0] for x in R.render(result.stats, config)] == ["lines", "3", "3"]


def test_any_failure_is_an_error_row(spark, tree, monkeypatch):
    from textloom.sources import files as S

    monkeypatch.setattr(S, "MOST_BYTES", 15)
    config = C.Config(walk=C.WalkOptions(roots=[str(tree)]), filter=C.FilterConfig(allow_ext=["rs"]))
    reader = S._Reader({"config": json.dumps({"walk": {"roots": [str(tree)]}, "filter": {"mtime_since": None, "mtime_until": None, "allow_ext": ["rs"]}})})
    row = next(iter(reader.read(reader.partitions()[0]))).to_pylist()[0]
    assert row["content"] is None and row["error"].endswith("over 15 bytes") and config.walk.roots
    monkeypatch.setattr("builtins.open", lambda *a, **k: (_ for _ in ()).throw(MemoryError("too much")))
    assert next(iter(reader.read(S._Batch([S.Found("/x/y.rs", 3, None)])))).to_pylist()[0]["error"] == "Failed to read file '/x/y.rs': too much"


def test_reads_ask_for_what_there_is(tmp_path, monkeypatch):
    """A read takes room for a file's size, not for the bound; a file that grew or shrank since the walk is read whole."""
    from textloom.sources import files as S

    asked, real = [], open

    class Watched:
        def __init__(self, *a):
            self.file = real(*a)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n=-1):
            asked.append(n)
            return self.file.read(n)

    (tmp_path / "x.rs").write_bytes(b"0123456789")
    reader = S._Reader({"config": json.dumps({"walk": {"roots": []}, "filter": {"mtime_since": None, "mtime_until": None}})})
    read = lambda size: next(iter(reader.read(S._Batch([S.Found(str(tmp_path / "x.rs"), size, None)])))).to_pylist()[0]
    monkeypatch.setattr("builtins.open", Watched)
    assert read(10)["content"] == b"0123456789" and asked == [11]
    assert [read(n)["content"] for n in (0, 3, 9, 11, 1 << 40)] == [b"0123456789"] * 5
    monkeypatch.setattr(S, "MOST_BYTES", 9)
    assert all(read(n)["error"].endswith("over 9 bytes") and read(n)["content"] is None for n in (0, 8, 9, 10, 99))
    monkeypatch.setattr(S, "MOST_BYTES", 10)
    assert all(read(n)["content"] == b"0123456789" for n in (0, 9, 10, 11))


def test_main(spark, tree, capsys):
    assert main([str(tree), "--format", "csv", "--ext", "rs"], spark) == 0
    assert capsys.readouterr().out.splitlines()[1].startswith("3,20,")
    assert main(["../../../..", "--strict"], spark) == 1


def test_totals_of_nothing(spark):
    assert tuple(totals(spark.createDataFrame([], FILE_STATS)).first()) == (0, 0, 0, 0, 0)


def snapshot(path, rows):
    full = [{"path": p, "lines": n, "chars": c, "words": w, "size": 1, "mtime": "2024-01-02T03:04:05.123456789+02:00", "ext": "", "name": p, "is_binary": False} for p, n, c, w in rows]
    path.write_text(json.dumps(full, indent=2))
    return str(path)


def test_compare(spark, tmp_path, capsys):
    old = snapshot(tmp_path / "old.json", [("a-b", 1, 1, 1), ("a/b", 2, 2, None), ("same", 5, 5, 5), ("gone", 3, 30, 300), ("twice", 1, 1, 1), ("twice", 2, 2, 2)])
    new = snapshot(tmp_path / "new.json", [("a-b", 4, 1, 1), ("a/b", 2, 2, 7), ("same", 5, 5, 5), ("fresh", 10, 20, 30), ("twice", 2, 2, 2)])
    rows = read_snapshot(spark, old)
    assert rows.where("sloc IS NULL").count() == 6 and rows.first().mtime.microsecond == 123456
    assert main(["--compare", old, new], spark) == 0
    assert capsys.readouterr().out.splitlines() == [
        "Comparison Summary", "-------------------", "Files: +1 -1 ~2 (2 unchanged)", "Lines: +10", "Chars: -10", "Words: -270", "",
        "### Added Files", "+ fresh (L:10, C:20)", "", "### Removed Files", "- gone (L:3, C:30)", "", "### Modified Files", "~ a/b (Lines: +0, Chars: +0)", "~ a-b (Lines: +3, Chars: +0)",
    ]
    o, n = read_snapshot(spark, old), read_snapshot(spark, new)
    assert [r.path for r in compare.added(o, n).collect()] == ["fresh"] and [r.path for r in compare.removed(o, n).collect()] == ["gone"]
    (tmp_path / "bad.json").write_text('{"path": 1')
    with pytest.raises(Exception):
        read_snapshot(spark, str(tmp_path / "bad.json")).collect()
    write_snapshot(o.drop("position"), str(tmp_path / "lines"))
    assert read_snapshot_lines(spark, str(tmp_path / "lines")).count() == 6


def test_watch(spark, tmp_path):
    (tmp_path / "w").mkdir()
    seen = []
    before = fingerprint([str(tmp_path / "w")])
    query = on_change(spark, [str(tmp_path / "w")], 0.2, lambda: seen.append(1))
    try:
        for wanted in (1, 2):
            until = time.time() + 40
            while len(seen) < wanted and time.time() < until:
                time.sleep(0.1)
            assert len(seen) == wanted
            (tmp_path / "w" / f"{wanted}.txt").write_text("x")
    finally:
        query.stop()
    assert fingerprint([str(tmp_path / "w")]) != before
