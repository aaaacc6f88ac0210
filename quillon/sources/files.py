"""The few file operations the table store needs, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Hadoop's FileSystem behind a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def full(self, name: str) -> str:
        return self.path(name).toString()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does. It appears whole or not at all, also if the writer dies half way.

        The text is written beside it first. On a local disk a hard link then publishes it, elsewhere a rename that fails where the
        target exists: both are one step, and a writer that dies before leaves nothing but a temporary file.
        """
        if self.exists(name):
            return False
        folder, _, last = name.rpartition("/")
        temp = f"{folder}/.{last}.{self.jvm.java.util.UUID.randomUUID().toString()}"
        stream = self.fs.create(self.path(temp), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.root.toUri().getScheme() == "file":
                local = [self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath() for x in (name, temp)]
                self.jvm.java.nio.file.Files.createLink(*local)
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                none = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 0)
                context.rename(self.path(temp), self.path(name), none)
            return True
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        finally:
            self.fs.delete(self.path(temp), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
