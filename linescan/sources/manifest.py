"""Which files of an output folder count: manifests beside the folder.

A write puts its files aside, then a manifest that names every file of the folder
and what has to be moved and removed to get there, and only then moves and
removes. The manifest is put in place by one rename, so whoever reads by it sees
all of a write or nothing, wherever a writer stopped; the next write finishes what
another one left. Manifests of ``/data/found`` lie in ``/data/_found.manifest``,
which Spark's readers pass over, so the folder itself holds lines only. One write
at a time may go to a folder.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Moves and removals that run at once.
THREADS = 16
CURRENT_SCHEMA = "prefix string, file string, path string, lines long, plaintext_bytes long, compressed_bytes long"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def delete(system, path: str) -> None:
    try:
        system.delete_file(path)
    except OSError:  # gone already
        pass


def exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Entry:
    """A file of the folder; ``staged`` says where it lies until it is moved."""

    prefix: str
    file: str
    lines: int = 0
    plaintext_bytes: int = 0
    compressed_bytes: int = 0
    staged: str | None = None


@dataclass
class Manifest:
    """``files`` is all that counts after the write, ``removes`` what earlier writes put there and this one replaced."""

    run: str
    number: int
    files: list[Entry] = field(default_factory=list)
    removes: list[str] = field(default_factory=list)
    pending: bool = True

    @property
    def name(self) -> str:
        return f"{self.number:08d}-{self.run}"


class Folder:
    """The files of one output folder, by its manifests."""

    def __init__(self, directory: str):
        self.system, root = file_system(directory)
        self.root = root.rstrip("/")
        self.scheme = directory.rstrip("/").removesuffix(self.root)  # what Spark needs before a path
        parent, _, base = self.root.rpartition("/")
        self.side = f"{parent}/_{base}.manifest"

    def staging(self, run: str) -> str:
        """Where the files of a write wait."""
        return f"{self.side}/staged-{run}"

    def latest(self) -> Manifest | None:
        """The manifest that counts."""
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.side, allow_not_found=True))
        names = [i.base_name for i in found if i.base_name.endswith((".json", ".pending"))]
        # Done by rename, so a manifest is pending or it is not; of two of one write the finished one counts.
        for name in sorted(names, key=lambda n: (n.rsplit(".", 1)[0], n.endswith(".json")), reverse=True)[:1]:
            with self.system.open_input_stream(f"{self.side}/{name}") as stream:
                held = json.loads(stream.read())
            return Manifest(held["run"], held["number"], [Entry(**e) for e in held["files"]], held["removes"], name.endswith(".pending"))
        return None

    def path_of(self, entry: Entry) -> str:
        """Where the file lies now."""
        return entry.staged if entry.staged and exists(self.system, entry.staged) else f"{self.root}/{entry.file}"

    def names_for(self, sizes: dict[tuple[str, int | None], int], before: Manifest | None) -> dict[tuple[str, int | None], list[str]]:
        """File names for (prefix, part): ``prefix.zst``, ``prefix-part.zst``, with ``.part-k`` where there are several files.

        No file gets the name that another prefix's file has, of this write or an earlier one.
        """
        replaced = {prefix for prefix, _ in sizes}
        taken = {e.file for e in before.files if e.prefix not in replaced} if before else set()
        out = {}
        for own in (True, False):  # whole prefixes first: a split one goes out of their way
            for (prefix, part), n in sorted(sizes.items(), key=str):
                stem = prefix if part is None else f"{prefix}-{part}"
                if own != (part is None and n == 1):
                    continue
                names = [f"{stem}.zst"] if n == 1 and f"{stem}.zst" not in taken else []
                k = 0
                while len(names) < n:
                    if (name := f"{stem}.part-{k}.zst") not in taken:
                        names.append(name)
                    k += 1
                taken.update(names)
                out[prefix, part] = names
        return out

    def commit(self, run: str, files: list[Entry]) -> None:
        """Make ``files`` all that there is of their prefixes; files of other prefixes stay."""
        self.settle()
        before = self.latest()
        replaced, names = {e.prefix for e in files}, {e.file for e in files}
        kept = [e for e in before.files if e.prefix not in replaced] if before else []
        removes = [e.file for e in before.files if e.prefix in replaced and e.file not in names] if before else []
        now = Manifest(run, before.number + 1 if before else 0, [*kept, *files], removes)
        self._put(now)
        self.settle(now)

    def _put(self, manifest: Manifest) -> None:
        self.system.create_dir(self.side, recursive=True)
        hidden = f"{self.side}/.{manifest.name}.tmp"
        held = {"run": manifest.run, "number": manifest.number, "files": [asdict(e) for e in manifest.files], "removes": manifest.removes}
        with self.system.open_output_stream(hidden) as sink:
            sink.write(json.dumps(held).encode())
        self.system.move(hidden, f"{self.side}/{manifest.name}.pending")

    def settle(self, manifest: Manifest | None = None) -> None:
        """Finish the latest write if it was not: move, remove, and mark it as done. Every step may be repeated."""
        manifest = manifest or self.latest()
        if manifest is None or not manifest.pending:
            return
        staged = [e for e in manifest.files if e.staged]
        for folder in sorted({f"{self.root}/{e.file}".rpartition("/")[0] for e in staged}):
            self.system.create_dir(folder, recursive=True)

        def move(e: Entry) -> None:
            if exists(self.system, e.staged):
                self.system.move(e.staged, f"{self.root}/{e.file}")

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(move, staged))
            list(pool.map(lambda f: delete(self.system, f"{self.root}/{f}"), manifest.removes))
        for e in staged:
            e.staged = None
        done = Manifest(manifest.run, manifest.number, manifest.files, [], False)
        self._put(done)  # the same name, without what is done
        self.system.move(f"{self.side}/{done.name}.pending", f"{self.side}/{done.name}.json")
        self.drop_staging(manifest.run)
        self._forget(done.number)

    def drop_staging(self, run: str) -> None:
        try:
            self.system.delete_dir(self.staging(run))
        except OSError:  # there is none
            pass

    def _forget(self, number: int) -> None:
        """Remove manifests before the latest one: each names all files."""
        from pyarrow import fs

        for info in self.system.get_file_info(fs.FileSelector(self.side, allow_not_found=True)):
            first = info.base_name.split("-")[0]
            if info.is_file and first.isdigit() and int(first) < number:
                delete(self.system, info.path)


def current_files(spark: SparkSession, directory: str) -> DataFrame:
    """(prefix, file, path, lines, plaintext_bytes, compressed_bytes) of the files that count in an output folder.

    ``path`` is where a file lies now: beside the folder if its write stopped before it was moved. Files that no
    manifest names are left out. A folder without manifests has none.
    """
    folder = Folder(directory)
    now = folder.latest()
    rows = [(e.prefix, e.file, folder.scheme + folder.path_of(e), e.lines, e.plaintext_bytes, e.compressed_bytes) for e in now.files] if now else []
    return spark.createDataFrame(rows, CURRENT_SCHEMA)


def with_prefix(rows: DataFrame, directory: str) -> DataFrame:
    """``rows`` (with ``key``, relative to an output folder) plus the prefix that the file of that name was written for.

    The names alone do not tell it: ``x-1.zst`` may be a file of x or of x-1, and a split prefix is several files. A
    file that no manifest names has a null prefix.
    """
    files = current_files(rows.sparkSession, directory).select(F.col("file").alias("key"), "prefix")
    return rows.join(files, "key", "left")
