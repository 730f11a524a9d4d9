"""Finding data files and unpacking archives, on any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession


class _Folder:
    """A folder through Hadoop's file systems; plain paths are those of the default one."""

    def __init__(self, root: str | Path) -> None:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("files are found through a Spark session")
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"file://{root}" if isinstance(root, Path) else str(root))
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def has(self, name: str) -> bool:
        return self.fs.exists(self.child(name))

    def entries(self) -> list[str]:
        """Every file below and every folder that is one table, by the end of its name; sorted."""
        found, todo = [], [self.path]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                table = s.getPath().getName().lower().endswith((".csv", ".parquet", ".txt"))
                (found if s.isFile() or table else todo).append(s.getPath())
        return sorted(p.toString() for p in found)


def find_file(root: str | Path, name: str) -> str:
    """root/name, else the first file of that name below root."""
    folder = _Folder(root)
    if folder.has(name):
        return folder.fs.getFileStatus(folder.child(name)).getPath().toString()
    last = PurePosixPath(name).name
    below = [f for f in folder.entries() if PurePosixPath(f).name == last]
    if not below:
        raise FileNotFoundError(f"{name} is not below {root}")
    return below[0]


def find_tabular(root: str | Path, prefer: Sequence[str] = ()) -> str:
    """A .csv or .parquet file below root: the first whose name has the earliest term of prefer, else the first."""
    every = [PurePosixPath(f) for f in _Folder(root).entries()]
    every = [f for f in every if f.suffix.lower() in (".csv", ".parquet") and "__MACOSX" not in f.parts and not f.name.startswith("._")]
    if not every:
        raise FileNotFoundError(f"no .csv or .parquet file below {root}")
    rank = lambda f: next((k for k, term in enumerate(prefer) if term.lower() in f.name.lower()), len(prefer))
    return _uri(min(every, key=rank))


def _uri(path: PurePosixPath) -> str:
    """The address that pathlib shortened: file:/x and hdfs:/host/x stand for file:/x and hdfs://host/x."""
    scheme, _, rest = str(path).partition(":/")
    return str(path) if not rest or scheme == "file" else f"{scheme}://{rest}"


def require_files(root: str | Path, names: Sequence[str]) -> list[str]:
    return [find_file(root, n) for n in names]


def archives(root: str | Path) -> list[str]:
    """The .zip files in root itself."""
    folder = _Folder(root)
    return sorted(s.getPath().toString() for s in folder.fs.listStatus(folder.path) if s.isFile() and s.getPath().getName().endswith(".zip"))


def exists(path: str | Path) -> bool:
    folder = _Folder(path)
    return folder.fs.exists(folder.path)


def extract_zip(archive: str | Path, target: str | Path) -> list[str]:
    """Unpack archive into target; members that would land outside are refused before anything is written. Bytes pass through the driver's JVM in a stream."""
    source, out = _Folder(archive), _Folder(target)
    jvm = source.jvm

    def members():
        stream = jvm.java.util.zip.ZipInputStream(source.fs.open(source.path))
        try:
            while (entry := stream.getNextEntry()) is not None:
                if not entry.isDirectory():
                    yield entry.getName(), stream
        finally:
            stream.close()

    names = [n for n, _ in members()]
    if any(n.startswith("/") or ".." in PurePosixPath(n.replace("\\", "/")).parts for n in names):
        raise ValueError(f"{archive} has a member outside of the target")
    written = []
    for name, stream in members():
        at = out.child(name)
        file = out.fs.create(at, True)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, file, 1 << 16, False)
        finally:
            file.close()
        written.append(out.fs.getFileStatus(at).getPath().toString())
    return written
