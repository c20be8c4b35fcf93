"""Files that Python data sources read and write, through Arrow's file systems (local, hdfs://, s3://, ...)."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files at or below a path, in order, with their sizes; hidden ones and indexes of writers left out."""
    files, own = opened(path)
    info = files.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(own, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def read(path: str, name: str) -> bytes:
    files, _ = opened(path)
    with files.open_input_stream(name, compression=None) as f:
        return f.read()


def tail(path: str, name: str, foot: int, size_of) -> bytes:
    """The end of a file whose last foot bytes tell how many belong to it; no more is read."""
    files, _ = opened(path)
    with files.open_input_file(name) as f:
        size = f.size()
        f.seek(max(0, size - foot))
        last = f.read(foot)
        f.seek(max(0, size - size_of(last)))
        return f.read()


def publish(path: str, moves: list[tuple[str, str]], overwrite: bool) -> None:
    """Gives written files their names; with overwrite, what was there before goes afterwards."""
    files, own = opened(path)
    old = [x.path for x in files.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and "/_" not in x.path[len(own) :]] if overwrite else []
    for temporary, final in moves:
        files.create_dir(final.rsplit("/", 1)[0], recursive=True)
        files.move(temporary, final)
    for name in set(old) - {final for _, final in moves}:
        files.delete_file(name)


def below(path: str, folder: str) -> list[tuple[str, str]]:
    """Files in a folder, with their paths from there."""
    files, _ = opened(path)
    found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return [(x.path, x.path[len(folder) + 1 :]) for x in found if x.type == fs.FileType.File]
