import pytest
from pyarrow import fs

from postsieve.llm.store import make_folder, opened, write_whole


@pytest.mark.parametrize("uri", ["dbfs:/x", "hdfs:/x", "s3a:/x"])
def test_names_that_are_no_whole_uri_are_refused(uri):
    with pytest.raises(ValueError, match="share"):
        opened(uri)


def test_paths_and_file_uris(tmp_path):
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        store, path = opened(uri)
        assert isinstance(store, fs.LocalFileSystem) and path == str(tmp_path)


def test_a_repeated_task_leaves_one_whole_file(tmp_path):
    folder = f"file:{tmp_path}/a"
    make_folder(folder)
    for attempt in (1, 2):
        write_whole(folder, "part", attempt, [b"x", b"yz"])
    assert [f.name for f in (tmp_path / "a").iterdir()] == ["part"] and (tmp_path / "a" / "part").read_bytes() == b"xyz"
