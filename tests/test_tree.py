import io
import os
import subprocess
from datetime import UTC, datetime

import pytest

from arborlake import cli
from arborlake.config import ConfigError, Consumer, parse_config
from arborlake.sources.baseline import read_baseline, write_baseline
from arborlake.sources.content import staged_digests
from arborlake.sources.fstree import scan_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    content = {"notes/short.txt": b"a short note\n", "notes/copy1.dat": b"seventeen bytes..", "more/copy2.dat": b"seventeen bytes..", "more/other.bin": os.urandom(2048), "large/pic.bin": os.urandom(1_100_000), "node_modules/x.js": b"js"}
    for name, data in content.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def run(spark, tmp_path, *args):
    out = io.StringIO()
    p = vars(cli.parser().parse_args([str(a) for a in args]))
    keys = ("target", "consumer", "exclude", "min_size", "file_extensions", "action", "sort", "order", "hard_delete", "min_size_recursive", "baseline", "growth_threshold", "out")
    config = parse_config(**{k: p[k] for k in keys})
    cli.run(config, spark, os.path.normpath(os.path.abspath(config.target)), out)
    return out.getvalue()


def test_scan_finds_every_regular_file(spark, tmp_path):
    for name in (".bashrc", "_x.txt", ".hid/z", "_u/q.txt", "sub/a.TXT", "sub/empty.bin", "skip/x"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"1")
    os.symlink("a.TXT", tmp_path / "sub/link.txt")
    os.symlink("..", tmp_path / "sub/up")
    os.link(tmp_path / "_x.txt", tmp_path / "hard.txt")
    with open(os.fsencode(tmp_path) + b"/bad\xff", "wb"):
        pass
    got = scan_tree(spark, str(tmp_path), ["skip"], tasks=3).collect()
    assert sorted(r.path.removeprefix(f"{tmp_path}/") for r in got if r.entry_kind == "file") == sorted([".bashrc", "_x.txt", ".hid/z", "_u/q.txt", "sub/a.TXT", "sub/empty.bin", "hard.txt"])
    assert [r.entry_kind for r in got if r.entry_kind != "file"] == ["inaccessible_file"]
    inode = {r.name: r.ino for r in got}
    assert inode["_x.txt"] == inode["hard.txt"]
    assert [r.entry_kind for r in scan_tree(spark, str(tmp_path / "none")).collect()] == ["inaccessible_dir"]


def test_staged_digests(spark, tmp_path):
    head = b"h" * 4096
    for name, data in {"a": head + b"1", "b": head + b"2", "c": head + b"1", "d": b"x", "e": b"x", "f": b"y"}.items():
        (tmp_path / name).write_bytes(data)
    files = scan_tree(spark, str(tmp_path)).select("path", "size")
    found, unread = staged_digests(files.unionByName(spark.createDataFrame([(f"{tmp_path}/gone", 1)], "path string, size long")))
    assert sorted(r.path[-1] for r in found.collect()) == ["a", "c", "d", "e"] and unread == 1


def test_aggregate(spark, tmp_path, tree):
    text = run(spark, tmp_path, "--exclude=.git,node_modules", tree)
    for label, n, size in (("bucket", "count", "bytes"), ("<= 1KB", 3, "47 B"), ("> 1KB and <= 1MB", 1, "2.00 KB"), ("> 1MB and <= 20MB", 1, "1.05 MB"), ("> 1GB", 0, "0 B"), ("total", 5, "1.05 MB")):
        assert f"    {label:<20} {n:>10} {size:>15}\n" in text
    assert "Files=5 " in text and "\nDates (" in text
    assert "Files=6 " in run(spark, tmp_path, tree)


def test_filters(spark, tmp_path, tree):
    text = run(spark, tmp_path, "--exclude=node_modules", "--min-size=1KB", "--file-extensions=bin", tree)
    assert "Skipped (size < 1.00 KB): 3 files" in text and "Skipped (extension not in [bin]): 0 files (0 B)." in text and "Files=2 " in text


def test_listing_and_mirror(spark, tmp_path, tree):
    text = run(spark, tmp_path, "--consumer=filemanager", "--exclude=node_modules", "--sort=size", f"--out={tmp_path}/out.txt", tree)
    rows = [x for x in text.splitlines() if str(tree) in x and "Scanning" not in x]
    assert len(rows) == 5 and rows[0].endswith(tuple("0123456789")) and "pic.bin" in rows[0] and "Listed 5 files" in text
    assert (tmp_path / "out.txt").read_text() == text


@pytest.mark.parametrize("hard", [False, True])
def test_delete_script_runs(spark, tmp_path, tree, hard):
    (tree / 'odd $(touch pwned) "`x` \\ \n name').write_bytes(b"1")
    script = tmp_path / "s" / "del.sh"
    text = run(spark, tmp_path, "--consumer=filemanager", "--action=delete", "--exclude=node_modules", f"--out={script}", *(["--hard-delete"] if hard else []), tree)
    assert "6 files" in text
    done = subprocess.run(["bash", str(script)], input="no\n", capture_output=True, text=True)
    assert done.returncode == 1 and (tree / "notes/short.txt").exists()
    done = subprocess.run(["bash", str(script)], input="DELETE\n" if hard else "y\n", capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    assert not [f for d, _, fs in os.walk(tree) for f in fs if "node_modules" not in d]
    assert not (tmp_path / "pwned").exists()
    assert hard or len(os.listdir(script.parent / "trash")) == 6


def test_nothing_to_delete(spark, tmp_path, tree):
    assert "there is no script" in run(spark, tmp_path, "--consumer=filemanager", "--action=delete", "--min-size=1TB", f"--out={tmp_path}/x.sh", tree)
    assert not (tmp_path / "x.sh").exists()


def test_duplicates_script(spark, tmp_path, tree):
    os.link(tree / "notes/copy1.dat", tree / "notes/hard.dat")
    script = tmp_path / "dups.sh"
    text = run(spark, tmp_path, "--consumer=duplicates", f"--out={script}", tree)
    assert "1 copies in 1 groups hold 17 B." in text
    body = script.read_text()
    assert body.count("# KEPT") == 1 and body.count('\nmv "') == 1 and "more/copy2.dat" in body.split("# KEPT")[1].split("\n")[0]
    assert subprocess.run(["bash", "-n", str(script)]).returncode == 0
    assert "No two files are alike" in run(spark, tmp_path, "--consumer=duplicates", "--min-size=1KB", f"--out={tmp_path}/y.sh", tree)


def test_folders_and_growth(spark, tmp_path):
    root, base = tmp_path / "t", tmp_path / "b.tsv"
    for name, n in (("grower/g.bin", 100_000), ("stable/s.bin", 100_000)):
        (root / name).parent.mkdir(parents=True)
        (root / name).write_bytes(b"0" * n)
    args = ("--consumer=folders", "--min-size-recursive=0", f"--baseline={base}", root)
    first = run(spark, tmp_path, *args)
    assert "growth since" not in first and "Listed 3 folders" in first and base.exists()
    (root / "grower/g.bin").write_bytes(b"0" * 150_000)
    (root / "fresh").mkdir()
    (root / "fresh/n.bin").write_bytes(b"0" * 100_000)
    second = run(spark, tmp_path, *args)
    grown, fresh = second.split("Folder growth since")[1].split("New folders since")
    assert "grower" in grown and "50.0%" in grown and "stable" not in grown and "fresh" in fresh and "grower" not in fresh
    assert "large" not in run(spark, tmp_path, "--consumer=folders", root)


def test_baseline_round_trip(spark, tmp_path):
    file, at = str(tmp_path / "n" / "b.tsv"), datetime(2025, 2, 3, 4, tzinfo=UTC)
    write_baseline(file, at, [("/vol/with space", 3, 100), ("/vol/zwei", 5, 200)])
    assert open(file).read() == "# 2025-02-03T04:00:00Z\n100\t3\t/vol/with space\n200\t5\t/vol/zwei\n"
    since, rows = read_baseline(spark, file)
    assert since == at and sorted(map(tuple, rows.collect())) == [("/vol/with space", 100), ("/vol/zwei", 200)]
    open(file, "a").write("1\t1\t/vol/zwei\n")
    assert ("/vol/zwei", 1) in map(tuple, read_baseline(spark, file)[1].collect())
    for bad in ("100\t3\n", "x\t1\t/a\n"):
        open(file, "w").write("# 2025-02-03T04:00:00Z\n" + bad)
        with pytest.raises(ValueError, match="malformed"):
            read_baseline(spark, file)
    open(file, "w").write("1\t1\t/a\n")
    with pytest.raises(ValueError, match="instant"):
        read_baseline(spark, file)
    with pytest.raises(ValueError, match="line end"):
        write_baseline(file, at, [("/a\nb", 1, 1)])


def test_config():
    c = parse_config()
    assert (c.consumer, c.min_size_recursive, c.excluded, c.ascending) == (Consumer.AGGREGATE, 0, (".git",), True)
    assert parse_config(consumer="folders").min_size_recursive == 10 << 20 and parse_config(consumer="folders", min_size_recursive="0").min_size_recursive == 0
    assert not parse_config(consumer="filemanager", sort="DATE").ascending
    with pytest.raises(ConfigError) as e:
        parse_config(consumer="Folders", action="x", sort="y", hard_delete=True, min_size="1.5KB", min_size_recursive="9e9", growth_threshold="NaN", baseline="b")
    assert len(str(e.value).split("\n")) >= 8
    for flags in ({"growth_threshold": "5"}, {"action": "list"}, {"sort": "path"}, {"baseline": "x"}, {"min_size_recursive": "1"}, {"hard_delete": True}):
        with pytest.raises(ConfigError):
            parse_config(**flags)
    with pytest.raises(ConfigError, match="negative"):
        parse_config(consumer="folders", baseline="b", growth_threshold="-1")


def test_exit_codes(spark, tmp_path, capsys):
    assert cli.main([str(tmp_path / "missing")], spark) == 2
    assert cli.main(["--examples"], spark) == 2 and cli.main(["--nope"], spark) == 2 and cli.main(["--producers=0", str(tmp_path)], spark) == 2
    assert cli.main(["--help", "--examples"], spark) == 0 and "Examples:" in capsys.readouterr().out
    assert cli.main(["--version"], spark) == 0 and cli.main(["--min-size=1", "--min-size=0", str(tmp_path)], spark) == 0


def test_a_folder_that_cannot_be_read_within_a_walk(tmp_path, monkeypatch):
    from arborlake.sources import fstree

    for name in ("a/x", "b/shut/y", "b/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    real = os.scandir

    def scandir(folder):
        if str(folder).endswith("/shut"):
            raise PermissionError(folder)
        return real(folder)

    monkeypatch.setattr(fstree.os, "scandir", scandir)
    reader = fstree.TreeReader(str(tmp_path), frozenset(), 1)
    got = [r for part in reader.partitions() for r in reader.read(part)]
    assert sorted((r[0], r[2]) for r in got) == [("file", "x"), ("file", "z"), ("inaccessible_dir", "shut")]
