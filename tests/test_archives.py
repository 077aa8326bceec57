import io
import stat
import tarfile
import zipfile

from findinglake.operators import reports
from findinglake.sources.archives import Limits, clean_member, read_uploads, unpacked


def _zip(*members, link=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
        if link:
            info = zipfile.ZipInfo(link)
            info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, "target")
    return out.getvalue()


def _tar(mode, *members, link=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        if link:
            info = tarfile.TarInfo(link)
            info.type, info.linkname = tarfile.SYMTYPE, "x"
            t.addfile(info)
    return out.getvalue()


def _of(name, data, limits=Limits()):
    return [(p, n, note, error) for p, n, _, note, error in unpacked(name, data, limits)]


def test_paths():
    given = {"a/./b": "a/b", "a\\b": "a/b", "../a": None, "/a": None, "C:/a": None, "a\0b": None, ".": None, "": None, "a//b": "a/b"}
    assert {n: clean_member(n) for n in given} == given


def test_zip_and_tar_members():
    same = [("top/a.py", b"1"), ("top/b/c.py", b"22")]
    assert _of("x.ZIP", _zip(*same)) == _of("x.tar.gz", _tar("w:gz", *same)) == [("a.py", 1, None, None), ("b/c.py", 2, None, None)]
    assert _of("x.zip", _zip(("a", b"1"), ("b/c", b"2"), link="l")) == [("l", None, "not a regular file", None), ("a", 1, None, None), ("b/c", 1, None, None)]
    assert _of("x.tar", _tar("w", ("a", b"1"), link="l")) == [("l", None, "not a regular file", None), ("a", 1, None, None)]
    assert _of("x.tar.bz2", _tar("w:bz2", ("a", b"1"), ("./a", b"2"))) == [("a", 1, None, None)]  # a repeated path, untold
    assert _of("x.zip", _zip(("a", b"1"), ("./a", b"2"))) == [("a", 1, None, None), ("a", None, "duplicate entry", None)]


def test_whole_archives_are_rejected():
    error = lambda name, data, **limits: [e for _, _, _, e in _of(name, data, Limits(**limits))]
    assert error("x.zip", _zip(("ok", b"1"), ("../evil", b"2"))) == ["unsafe path: ../evil"]
    assert error("x.tar", _tar("w", ("ok", b"1"), ("/etc/x", b"2"))) == ["unsafe path: /etc/x"]
    assert error("x.zip", _zip(("a", b"1"), ("b", b"2")), files=1) == ["more than 1 files"]
    assert error("x.tar", _tar("w", ("a", b"12345")), total=4) == ["the extracted size is over the limit"]
    assert error("x.zip", _zip(("a", b"12345")), file=4) == ["the extracted size is over the limit"]
    assert error("x.zip", _zip(("a", b"\0" * (3 << 20)))) == ["suspicious compression ratio"]
    for name in ("x.zip", "x.tar", "x.tgz", "x.tar.xz"):
        assert error(name, b"no archive") == ["not a valid archive"]


def test_uploads(spark):
    rows = [("a.py", b"x"), ("b.zip", _zip(("c", b"1"), ("d", b"2"))), ("b.zip", None), (None, b"1"), ("../bad|name", b"1"), ("a.py", b"x")]
    df = spark.createDataFrame([(n, c and bytearray(c), 1) for n, c in rows], "name string, content binary, size int")
    got = sorted((r.archive or "", r.path or "", r.size or 0, r.error or "") for r in read_uploads(df).collect())
    assert got == [("", "", 0, "not a valid archive"), ("../bad|name", "", 0, "invalid file name"), ("a.py", "a.py", 1, ""), ("a.py", "a.py", 1, ""),
                   ("b.zip", "", 0, "not a valid archive"), ("b.zip", "c", 1, ""), ("b.zip", "d", 1, "")]
    assert read_uploads(df.limit(0)).count() == 0


def test_reports_without_rows(spark, tmp_path):
    files = spark.createDataFrame([], "status string, language string, lines long")
    runs = spark.createDataFrame([], "ord int, scanner string, status string, detail string, findings int")
    row = reports.scope(files, runs).first()
    assert (row.files_total, row.files_analyzed, row.lines_analyzed, row.languages, row.scanners) == (0, 0, 0, [], [])
    f = spark.createDataFrame([], "exploitability string, verification string")
    d = spark.createDataFrame([], "vuln_status string")
    assert [r.ord for r in reports.limitations(files, runs, d, f).collect()] == [1, 2, 3] and reports.methodology(runs).count() == 1
    rows = spark.createDataFrame([(1, None), (2, 'a "b"')], "id int, title string")
    (folder,) = reports.write_reports(rows, str(tmp_path))
    assert sorted(r.value for r in spark.read.text(folder).collect()) == ['{"id":1}', '{"id":2,"title":"a \\"b\\""}']


def test_audit_entries_are_clipped(spark):
    df = spark.createDataFrame([({f"k{i}": "v" * 3000 for i in range(60)}, "u" * 400), ({}, ""), (None, None)], "details map<string,string>, user_agent string")
    a, b, c = reports.audit_entry(df).collect()
    assert len(a.details) == 50 and {len(v) for v in a.details.values()} == {2000} and len(a.user_agent) == 300
    assert (b.details, b.user_agent, c.details, c.user_agent) == ({}, None, None, None)
