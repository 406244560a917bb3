from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.functions import paths, shell, sizes
from arborlake.functions.calendar import Boundaries

MB = 1 << 20


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extensions(spark):
    cases = {"file.txt": "txt", "Code.JAVA": "java", "archive.tar.gz": "gz", ".bashrc": "(none)", "README": "(none)", "file.": "(none)", "photo.TIF": "tif", "..foo": "foo", "a.b.": "(none)", "x.a\nb": "a\nb", None: "(none)", "": "(none)"}
    assert column(spark, list(cases), paths.extension_of) == list(cases.values())


def test_parents_and_ancestors(spark):
    assert column(spark, ["/a/b", "/a", "/", "a", "/a/b/c.txt"], paths.parent_of) == ["/a", "/", None, None, "/a/b"]
    assert column(spark, ["/r/a/b", "/r", "/ra", "/x"], lambda c: paths.folders_up_to(c, "/r")) == [["/r", "/r/a", "/r/a/b"], ["/r"], [], []]
    assert column(spark, ["/", "/a/b"], lambda c: paths.folders_up_to(c, "/")) == [["/"], ["/", "/a", "/a/b"]]


def test_excluded_folders(spark):
    cases = {"/a/.git/x": True, "/a/.gitx/x": False, "/a/.git": False, "/a/.GIT/x": False}
    assert column(spark, list(cases), lambda c: paths.in_excluded_folder(c, [".git"])) == list(cases.values())


@pytest.mark.parametrize(
    "raw,want",
    [("*", None), (None, None), ("  ", None), ("txt,*,pdf", None), (".TXT, .JPG ,PDF", {"txt", "jpg", "pdf"}), ("txt,none", {"txt", "(none)"}), (", ,txt, ", {"txt"}), (".*", {"*"}), (",,", None)],
)
def test_extension_lists(raw, want):
    assert paths.parse_extensions(raw) == want


def test_display_and_excluded():
    assert paths.display_extensions(paths.parse_extensions("PDF,.TXT,jpg")) == "[jpg, pdf, txt]"
    assert paths.display_extensions(paths.parse_extensions("txt,none")) == "[(none), txt]" and paths.display_extensions(None) == "[*]"
    assert paths.parse_excluded(" a , ,b") == ["a", "b", ".git"] and paths.parse_excluded(".git,x") == [".git", "x"] and paths.parse_excluded(None) == [".git"]


def test_buckets(spark):
    cases = {0: 0, 1024: 0, 1025: 1, MB: 1, MB + 1: 2, 20 * MB: 2, 20 * MB + 1: 3, 1024 * MB: 3, 1024 * MB + 1: 4}
    assert column(spark, list(cases), sizes.size_bucket, "long") == list(cases.values())


def test_byte_texts(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1536: "1.50 KB", MB: "1.00 MB", 1 << 30: "1.00 GB", 1 << 40: "1.00 TB", 1048575: "1024.00 KB", 1152: "1.13 KB"}
    assert column(spark, list(cases), sizes.human_bytes, "long") == list(cases.values())
    assert [sizes.bytes_text(x) for x in cases] == list(cases.values())
    cells = {1024: "  1.0 KB", 524288: "512.0 KB", 0: "    0 B", 1023: " 1023 B"}
    assert column(spark, list(cells), sizes.human_bytes_column, "long") == list(cells.values())


def test_times_and_thresholds(spark):
    assert [sizes.elapsed_text(x) for x in (0, 59_900, 60_000, 90_000)] == ["0.0 s", "59.9 s", "60.0 s (1.0 m)", "90.0 s (1.5 m)"]
    assert sizes.percent_text(10.0) == "10" and sizes.percent_text(12.5) == "12.5"
    assert column(spark, [1_700_000_000_000, 0, -1], sizes.timestamp_text, "long") == ["2023-11-14 22:13:20", "1970-01-01 00:00:00", "1969-12-31 23:59:59"]


@pytest.mark.parametrize("raw,want", [(None, 0), ("  ", 0), ("4096", 4096), ("1kb", 1024), ("  512 KB  ", 524288), ("7B", 7), ("2TB", 2 << 40)])
def test_sizes(raw, want):
    assert sizes.parse_size(raw) == want


@pytest.mark.parametrize("raw", ["-1KB", "abc", "1.5KB", "KB", "9223372036854775808", "99999999999TB", "١KB"])
def test_bad_sizes(raw):
    with pytest.raises(ValueError):
        sizes.parse_size(raw)


def test_quoting(spark):
    cases = {'a"b': 'a\\"b', "$HOME": "\\$HOME", "`x`": "\\`x\\`", "\\$": "\\\\\\$", "a\nb": "a\nb"}
    assert [shell.quoted(x) for x in cases] == list(cases.values())
    assert column(spark, list(cases), shell.shell_quote) == list(cases.values())


def test_trash_names(spark):
    assert shell.trash_names(["/a/b/c.txt", "/a_b/c.txt", "/a_b_c.txt"]) == ["a_b_c.txt", "a_b_c.txt.1", "a_b_c.txt.2"]
    assert shell.trash_names(["/x", "/x.1", "/x"]) == ["x", "x.1", "x.2"]
    long = ["/s" * n + end for n in (100, 101, 127, 128, 129, 300) for end in ("", "é", "日本語" * 50, "🎉" * 40)]
    got = column(spark, long, shell.trash_name)
    assert got == [shell.capped(p.replace("/", "_").removeprefix("_")) for p in long]
    assert all(len(x.encode()) <= 255 for x in got) and len(set(got)) == len(got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("a/_.é1", max_size=12).map(lambda x: "/" + x), max_size=30))
def test_trash_names_are_distinct(values):
    assert len(set(shell.trash_names(values))) == len(values)


def test_boundaries():
    b = Boundaries.of(date(1998, 7, 2))  # a Thursday
    day = 86_400_000
    assert b.tomorrow - b.today == day and b.today - b.week == 4 * day and b.month == b.today - day
    assert Boundaries.of(date(2024, 1, 7)).week == Boundaries.of(date(2024, 1, 7)).today  # a Sunday
    spring = Boundaries.of(date(2024, 3, 31), "Europe/Berlin")
    assert spring.tomorrow - spring.today == day - 3_600_000


def test_whole_texts_are_quoted(spark, tmp_path):
    from arborlake.plans import inventory

    text = "x" * 100 + '"$HOME" `ls` \\ end' + "y" * 100
    spark.createDataFrame([(1, text), (2, "$")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.quoted for r in inventory.shell_quoting(spark, str(tmp_path)).collect()}
    assert got == {1: "x" * 100 + '\\"\\$HOME\\" \\`ls\\` \\\\ end' + "y" * 100, 2: "\\$"}
