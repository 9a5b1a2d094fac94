"""Files by path and by address."""

import pytest

from tessella.sources import storage


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_save_and_read(tmp_path, scheme):
    path = f"{scheme}{tmp_path}/a/b/x.bin"
    storage.save(path, [b"one", b"two"])
    storage.save(path, (x for x in [b"1234", b"", b"5"]))
    assert [p.name for p in (tmp_path / "a" / "b").iterdir()] == ["x.bin"]
    with storage.open_input(path) as f:
        f.seek(2)
        assert f.read() == b"345"
    assert storage.known(path) and not storage.known(path + "y") and not storage.known(f"{scheme}{tmp_path}/a")


def test_unknown_schemes():
    assert not storage.known("nosuch://host/x.osm.pbf")


def test_a_failed_write_leaves_no_file(tmp_path):
    def broken():
        yield b"half"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        storage.save(f"{tmp_path}/x", broken())
    assert not (tmp_path / "x").exists()
