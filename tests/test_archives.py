"""Archives by path: every header form, pieces of any size, broken files, bounded memory."""

import gzip
import hashlib
import io
import subprocess
import sys
import tarfile

import pytest

from lithic.sources.archives import archive_files, archive_pieces, scan_archive_files, whole_files

BIG = bytes(range(256)) * 40
MEMBERS = [("root-1/a.txt", b"hello"), ("root-1/empty", b""), ("p/" * 60 + "q" * 90, b"long " * 700), ("root-1/big.bin", BIG), ("root-1/ümlaut", b"x" * 512), ("z" * 300, b"last" * 128)]


def packed(form: int, members=MEMBERS, mode="w", defaults=None) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=form, pax_headers=defaults) as archive:
        folder, link = tarfile.TarInfo("root-1"), tarfile.TarInfo("root-1/link")
        folder.type, link.type, link.linkname = tarfile.DIRTYPE, tarfile.SYMTYPE, "a.txt"
        archive.addfile(folder)
        archive.addfile(link)
        for name, content in members:
            member = tarfile.TarInfo(name)
            member.size = len(content)
            archive.addfile(member, io.BytesIO(content))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    (at / "gnu.tar").write_bytes(packed(tarfile.GNU_FORMAT))
    (at / "pax.tar").write_bytes(packed(tarfile.PAX_FORMAT, defaults={"comment": "all"}))
    (at / "pax.tar.gz").write_bytes(packed(tarfile.PAX_FORMAT, mode="w:gz"))
    # two gzip streams, one behind the other
    raw = packed(tarfile.GNU_FORMAT)
    (at / "two.tgz").write_bytes(gzip.compress(raw[:3000]) + gzip.compress(raw[3000:]))
    (at / "ustar.tar").write_bytes(packed(tarfile.USTAR_FORMAT, MEMBERS[:-1]))
    return at


@pytest.mark.parametrize("split", [512, 6000, 1 << 30])
@pytest.mark.parametrize("part", [1000, 1 << 20])
def test_every_member_of_every_form(spark, folder, split, part):
    rows = scan_archive_files(spark, str(folder), part=part, split=split).collect()
    assert all(r.failure is None and len(r.content) <= part for r in rows)
    for name in ("gnu.tar", "pax.tar", "pax.tar.gz", "two.tgz", "ustar.tar"):
        own = sorted((r for r in rows if r.archive.endswith("/" + name)), key=lambda r: (r.path, r.part))
        expected = MEMBERS[:-1] if name == "ustar.tar" else MEMBERS
        assert {r.path for r in own} == {p for p, _ in expected}
        for path, content in expected:
            parts = [r for r in own if r.path == path]
            assert b"".join(r.content for r in parts) == content and [r.part for r in parts] == list(range(len(parts)))
            assert [r.last for r in parts] == [False] * (len(parts) - 1) + [True] and {r.size_bytes for r in parts} == {len(content)}
            assert parts[-1].content_hash == hashlib.sha256(content).hexdigest()


def test_plain_archives_are_dealt_out_and_streams_are_not(spark, folder):
    pieces = archive_pieces(archive_files(spark, str(folder)), 4000).collect()
    of = lambda name: sorted((p.begin, p.end) for p in pieces if p.archive.endswith("/" + name))
    assert of("pax.tar.gz") == [(0, None)] and of("two.tgz") == [(0, None)]
    cuts = of("gnu.tar")
    assert len(cuts) > 2 and cuts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))


def test_defaults_of_an_archive_hold_in_later_pieces(spark, tmp_path):
    raw = packed(tarfile.PAX_FORMAT, [(f"f{k}", b"x" * 2000) for k in range(9)], defaults={"path": "everywhere"})
    (tmp_path / "a.tar").write_bytes(raw)
    expected = [m.name for m in tarfile.open(fileobj=io.BytesIO(raw)) if m.isreg()]
    assert "everywhere" in expected
    assert sorted(r.path for r in whole_files(scan_archive_files(spark, str(tmp_path), split=3000)).collect()) == sorted(expected)


def test_broken_files(spark, tmp_path):
    raw = packed(tarfile.GNU_FORMAT, [("one", b"1" * 600), ("two", BIG)])
    (tmp_path / "cut.tar").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "cut.tgz").write_bytes(gzip.compress(raw, 0)[: len(raw) // 3])
    (tmp_path / "none.tar").write_bytes(b"no archive at all" * 100)
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "nothing.tar").write_bytes(packed(tarfile.GNU_FORMAT, []))
    rows = scan_archive_files(spark, str(tmp_path), part=1000).collect()
    failed = sorted(r.archive.rsplit("/", 1)[1] for r in rows if r.failure)
    assert failed == ["cut.tgz", "none.tar"]
    whole = whole_files(scan_archive_files(spark, str(tmp_path))).collect()
    assert {(r.archive.rsplit("/", 1)[1], r.path) for r in whole if "tgz" not in r.archive} == {("cut.tar", "one")}
    assert not [r for r in rows if r.path == "two" and r.last]


def test_no_archives(spark, tmp_path):
    assert scan_archive_files(spark, str(tmp_path)).count() == 0


CHILD = """
import resource, sys
import pyarrow as pa
from lithic.sources.archives import _reader, pieces_of, _PIECE
pa.set_memory_pool(pa.system_memory_pool())
list(pieces_of(sys.argv[1], 1 << 20))
held = int(next(x for x in open("/proc/self/status") if x.startswith("VmSize")).split()[1]) << 10
resource.setrlimit(resource.RLIMIT_AS, (held + (96 << 20), held + (96 << 20)))
total = 0
for uri, begin, end, defaults, failure in pieces_of(sys.argv[1], 128 << 20):
    piece = pa.record_batch([pa.array([x], f.type) for x, f in zip((uri, begin, end, list(defaults.items()), failure), _PIECE)], schema=_PIECE)
    for batch in _reader(4 << 20)([piece]):
        assert not any(batch.column(7).to_pylist()), batch.column(7)
        total += sum(len(x.as_py()) for x in batch.column(6))
print(total)
"""


@pytest.mark.parametrize("mode", ["w:", "w:gz"])
def test_an_archive_far_larger_than_the_memory(tmp_path, mode):
    size = 320 << 20
    at = tmp_path / "huge.tar"
    with open("/dev/zero", "rb") as zero, tarfile.open(at, mode, **({"compresslevel": 1} if mode == "w:gz" else {})) as archive:
        for name in ("one", "two"):
            member = tarfile.TarInfo(name)
            member.size = size
            archive.addfile(member, zero)
    done = subprocess.run([sys.executable, "-c", CHILD, str(at)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == 2 * size
