"""Folders of repositories as a data source: <root>/<owner>/<name>/<path>.

    spark.dataSource.register(RepositorySource)
    spark.read.format("wardline_repositories").option("root", folder).option("owners", "acme,widgets").load()

Each row is a file, or says why something was refused: an owner that is not allowed, a name of another form, a link that leads
out of the repository, a file that is too large or no text. Conditions on repo and on the beginning of path are pushed into the
reader, which then does not open the rest. Names alone are listed by the driver; files are listed and read in tasks, so the
folder must be one that all executors see. For stores that only Spark reads, take sources.tables.read_files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

SCHEMA = "repo string, path string, size bigint, content string, refused string"
NAME = r"^[a-z0-9]+(?:-[a-z0-9]+)*\Z"
MOST_BYTES, PER_PARTITION = 200 * 1024, 16


class Repositories(InputPartition):
    def __init__(self, found: list[tuple[str, str | None]]):
        self.found = found  # (owner/name, why it is refused)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("root"):
            raise ValueError("option root: the folder of owners")
        self.root, self.most = options["root"], int(options.get("mostbytes", MOST_BYTES))
        self.owners = None if options.get("owners") is None else {o.strip().lower() for o in options["owners"].split(",") if re.match(r"^[a-z0-9](?:[a-z0-9-]{0,38})\Z", o.strip().lower())}
        self.repo: str | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo",) and self.repo in (None, f.value):
                self.repo = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def _named(self) -> Iterator[tuple[str, str | None]]:
        for owner in sorted(os.listdir(self.root)):
            if not os.path.isdir(os.path.join(self.root, owner)):
                continue
            if self.owners is not None and owner.lower() not in self.owners:  # a setting without one valid name allows none
                yield owner, "owner not allowed"
                continue
            for name in sorted(os.listdir(os.path.join(self.root, owner))):
                bad = not re.match(NAME, name) or not os.path.isdir(os.path.join(self.root, owner, name))
                yield f"{owner}/{name}", "not a repository's name" if bad else None

    def partitions(self) -> Sequence[InputPartition]:
        found = [x for x in self._named() if self.repo in (None, x[0])]
        return [Repositories(found[i : i + PER_PARTITION]) for i in range(0, max(len(found), 1), PER_PARTITION)]

    def read(self, partition: Repositories) -> Iterator[tuple]:
        for repo, refused in partition.found:
            if refused:
                if not self.prefix:  # such a row has no path
                    yield repo, None, None, None, refused
                continue
            yield from self._files(repo)

    def _files(self, repo: str) -> Iterator[tuple]:
        top = Path(self.root, repo)
        real = os.path.realpath(top)
        if os.path.commonpath([real, os.path.realpath(self.root)]) != os.path.realpath(self.root):
            yield repo, None, None, None, "outside the folder"
            return
        for here, folders, names in os.walk(top):
            folders.sort()
            for name in sorted(names + [f for f in folders if os.path.islink(os.path.join(here, f))]):
                full = os.path.join(here, name)
                path = os.path.relpath(full, top).replace(os.sep, "/")
                if not path.startswith(self.prefix):
                    continue
                yield repo, path, *self._file(full, real)

    def _file(self, full: str, real: str) -> tuple[int | None, str | None, str | None]:
        """(size, content, why it is refused). Links count as what they lead to only inside the repository; folders behind links are not
        walked."""
        target = os.path.realpath(full)
        if os.path.commonpath([target, real]) != real:
            return None, None, "leads out of the repository"
        if not os.path.isfile(target) or os.path.islink(full):
            return None, None, "not a plain file"
        size = os.path.getsize(target)
        if size > self.most:
            return size, None, "too large"
        data = Path(target).read_bytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return size, None, "not text"
        return (size, None, "not text") if "\0" in text else (size, text, None)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wardline_repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})
