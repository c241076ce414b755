"""A keyed table as one base and small changes, with commits that can't overwrite each other, and its text tables.

Rows are in folders by hash of the key. A change writes only its own rows and keys; readers put base and changes together,
the last change of a key winning. A commit is one small file whose name is the next number, and is created only if no
file of that name is there, so of two writers that start from the same state one fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partloom.operators.postings import TextIndex, TextTables

#: Columns of stored rows: the bucket of the key, the commit that wrote the row, and the row's number in that.
BUCKET, COMMIT, ROW = "_bucket", "_commit", "_row"


class CommitConflict(RuntimeError):
    """Another writer has made this commit; read the new state and try again."""


class IndexStore:
    """Versions of a keyed table under one folder. With text, the inverted index of its fields is kept along with it.

    The folder's file system must refuse to create a file that exists, as HDFS and local disks do. With text, a key has one
    row at most, as one_row_each gives.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "subject", buckets: int = 32, text: TextTables | None = None):
        self.spark, self.path, self.key, self.buckets, self.text = spark, path.rstrip("/"), key, buckets, text

    # --- commits -----------------------------------------------------------------------------------------------------

    def _file_system(self, path: str):
        to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), to

    def _read(self, path: str) -> str:
        fs, to = self._file_system(path)
        stream = fs.open(to)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def head(self) -> tuple[int, list[dict]]:
        """(number of the last commit, its segments: the base and the changes since); (-1, []) for an empty store."""
        fs, folder = self._file_system(f"{self.path}/_commits")
        if not fs.exists(folder):
            return -1, []
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)
        for name in names:
            if text := self._read(f"{self.path}/_commits/{name}"):  # a file that is being written is empty
                return int(name), json.loads(text)
        return -1, []

    def _commit(self, number: int, segments: list[dict]) -> None:
        fs, to = self._file_system(f"{self.path}/_commits/{number:09d}")
        try:
            out = fs.create(to, False)
        except Exception as e:
            if "already exists" not in str(e):
                raise
            raise CommitConflict(f"commit {number} of {self.path} is taken") from None
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()

    def exists(self) -> bool:
        return self.head()[0] >= 0

    # --- reading -----------------------------------------------------------------------------------------------------

    def _union(self, segments: list[dict], part: str) -> DataFrame:
        frames = [self._stored(s[part]) if part != "postings" else self._stored(s[part]).withColumn(COMMIT, F.lit(s["commit"])) for s in segments if s.get(part)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _stored(self, at: list) -> DataFrame:
        name, schema = at
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/{name}")

    def rows(self, segments: list[dict] | None = None) -> DataFrame:
        """Live rows with the bucket, commit and number of each."""
        segments = self.head()[1] if segments is None else segments
        if not segments:
            raise ValueError(f"nothing is published in {self.path}")
        rows = self._union(segments, "rows")
        if not any(s["keys"] for s in segments):
            return rows
        last = self._union(segments, "keys").groupBy(self.key).agg(F.max(COMMIT).alias("_last"))
        return rows.join(last, self.key, "left").where(F.col("_last").isNull() | (F.col(COMMIT) >= F.col("_last"))).select(*rows.columns)

    def current(self) -> DataFrame:
        return self.rows().drop(BUCKET, COMMIT, ROW)

    def _bucket_of(self, key) -> F.Column:
        return F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(self.buckets)).cast("int")

    def lookup(self, subjects: list[str]) -> DataFrame:
        """The rows of a few keys; reads their buckets only."""
        import zlib

        wanted = sorted({zlib.crc32(s.encode()) % self.buckets for s in subjects})
        return self.rows().where(F.col(BUCKET).isin(wanted) & F.col(self.key).isin(subjects)).drop(BUCKET, COMMIT, ROW)

    def index(self) -> TextIndex:
        """The inverted index of the last commit."""
        if self.text is None:
            raise ValueError("this store keeps no text tables")
        segments = self.head()[1]
        parts = {p: self._union(segments, p) for p in ("postings", "terms", "totals", "pieces")}
        return TextIndex(self.text, self.rows(segments), self.key, changed=len(segments) > 1, **parts)

    # --- writing -----------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, by: str | None = None) -> list:
        """[folder, schema] as a segment has them: an empty table has no file that tells its columns."""
        name = f"{kind}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return [name, df.schema.jsonValue()]

    def _write_rows(self, rows: DataFrame, number: int) -> list:
        plain = rows.drop(BUCKET, COMMIT, ROW).withColumn(BUCKET, self._bucket_of(self.key))
        # buckets of any size: a large one is written by several tasks
        numbered = plain.hint("rebalance", BUCKET).withColumns({COMMIT: F.lit(number), ROW: F.monotonically_increasing_id()})
        return self._write(numbered, "rows", BUCKET)

    def _segment(self, number: int, rows: DataFrame | None, keys: DataFrame | None, old: DataFrame | None) -> dict:
        """Write rows, keys and text tables; old: rows that the keys replace, whose words are taken off the counts."""
        segment: dict = {"commit": number, "rows": None, "keys": None}
        if keys is not None:
            segment["keys"] = self._write(keys.select(self.key).distinct().withColumn(COMMIT, F.lit(number)), "keys")
        if rows is not None:
            segment["rows"] = self._write_rows(rows, number)
        if self.text is not None:
            lists = None
            if rows is not None:
                segment["postings"] = self._write(self.text.lists(self._stored(segment["rows"])), "postings", "bucket")
                lists = self._stored(segment["postings"])
            for part, (df, by) in self.text.counts(lists, old).items():
                segment[part] = self._write(df, part, by)
        return segment

    def publish(self, rows: DataFrame, **tables: DataFrame) -> int:
        """A new base, with other tables that belong to it; readers see the old state until all is complete. Returns the
        number of the commit."""
        number = self.head()[0] + 1
        segment = self._segment(number, rows, None, None)
        segment["tables"] = {name: self._write(df, "tables") for name, df in tables.items()}
        self._commit(number, [segment])
        return number

    def table(self, name: str) -> DataFrame:
        """A table published with the base."""
        return self._stored(self.head()[1][0]["tables"][name])

    def change(self, add: DataFrame | None = None, remove: DataFrame | None = None) -> int:
        """One commit that removes the keys of remove and puts the rows of add in the place of any of their keys.

        Writes what changes and nothing else. Raises CommitConflict, and leaves the state as it is, if another writer
        commits in the meantime.
        """
        number, segments = self.head()
        keys = [df.select(self.key) for df in (add, remove) if df is not None]
        if not segments or not keys:
            raise ValueError("publish first, and then change something")
        gone = reduce(lambda a, b: a.union(b), keys).distinct()
        old = self.rows(segments).join(gone, self.key, "left_semi") if self.text is not None else None
        self._commit(number + 1, [*segments, self._segment(number + 1, add, gone, old)])
        return number + 1

    def delete(self, subjects: DataFrame) -> int:
        return self.change(remove=subjects)

    def upsert(self, rows: DataFrame) -> int:
        return self.change(add=rows)

    def compact(self, most: int = 0) -> int:
        """A new base of the live rows, if there are more than so many changes. Returns the number of the last commit."""
        number, segments = self.head()
        if len(segments) <= most + 1:
            return number
        return self.publish(self.rows(segments), **{name: self._stored(at) for name, at in segments[0].get("tables", {}).items()})
