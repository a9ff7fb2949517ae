"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session alone may do without and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def no_path(error: Exception) -> bool:
    """Whether a read failed as nothing was written there yet."""
    return "PATH_NOT_FOUND" in str(error)


# ---------------------------------------------------------------- small files of a folder, through Arrow's file systems


def files_of(uri: str):
    """(file system, path) of a local path or a URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_file(uri: str) -> bytes | None:
    """A file's content, None if there is none."""
    files, path = files_of(uri)
    if not files.get_file_info(path).is_file:
        return None
    with files.open_input_stream(path) as source:
        return source.read()


def write_file(uri: str, data: bytes) -> None:
    """Written under another name first, so that a reader sees a whole file or none."""
    files, path = files_of(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as sink:
        sink.write(data)
    files.move(part, path)


def names_in(uri: str, folders: bool = False) -> list[str]:
    """Names of the files, or of the folders, directly in a folder."""
    from pyarrow import fs

    files, path = files_of(uri)
    if files.get_file_info(path).type != fs.FileType.Directory:
        return []
    wanted = fs.FileType.Directory if folders else fs.FileType.File
    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(path)) if x.type == wanted)


def delete_folder(uri: str) -> None:
    files, path = files_of(uri)
    files.delete_dir(path)


def delete_file(uri: str) -> None:
    files, path = files_of(uri)
    files.delete_file(path)


class Steps:
    """Tables of an iteration's steps as Parquet in the shared folder, deleted as soon as no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, *gone: DataFrame) -> DataFrame:
        """``df`` written; after that ``gone``, tables of earlier steps, are deleted."""
        self.n += 1
        path = f"{self.folder}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._evidex_path = path
        for table in gone:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(table._evidex_path)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return out
