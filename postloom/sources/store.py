"""The stored postings: a Parquet table in versions, appended in batches.

``<root>/v000001/writer=w/batch=7/part-*.parquet``. Every writer numbers its own
batches: an append writes that writer's batch folder, so a repeated batch
replaces itself and nothing else. A replace writes the next version
and leaves the old one whole; the newest version whose write finished is
current. Spark cannot overwrite a table it is reading, so nothing is
overwritten in place. ``<root>/index`` holds the keys of every batch (``key_index``), so that an
ingest does not read what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.schema import ARRIVAL, OUTPUT_COLUMNS, STORED
from postloom.scratch import Scratch
from postloom.sources import key_index
from postloom.sources.postings import conform, sink_text, unsink_text

_PLACE = ("writer", "batch")
_READ_SCHEMA = T.StructType(
    [*STORED.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
#: The writer of appends that name none.
DEFAULT_WRITER = "batch"
#: Last description of a session: its digest, and whether it was blanked.
MEMORY = T.StructType([
    T.StructField("layout", T.StringType()), T.StructField("session", T.StringType()),
    T.StructField("digest", T.BinaryType()), T.StructField("stale", T.BooleanType())])
#: Every so many batches the memory is written whole; the batches between hold the sessions they met.
WHOLE_MEMORY = 16


class PostingStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- folders -----------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def _versions(self) -> list[int]:
        names = [n for n in self._children(self.root) if n.startswith("v") and n[1:].isdigit()]
        fs = self._fs()
        # version 0 grows by appends; later ones count once their write finished
        return [
            int(n[1:]) for n in names
            if int(n[1:]) == 0 or fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))
        ]

    def _version_path(self, version: int) -> str:
        return f"{self.root}/v{version:06d}"

    def current(self) -> str:
        return self._version_path(max(self._versions(), default=0))

    def batches(self, writer: str = DEFAULT_WRITER) -> list[int]:
        return sorted(
            int(n.split("=", 1)[1]) for n in self._children(f"{self.current()}/writer={writer}") if n.startswith("batch=")
        )

    def writers(self) -> list[str]:
        return [n.split("=", 1)[1] for n in self._children(self.current()) if n.startswith("writer=")]

    # -- tables ------------------------------------------------------------

    def read(self, before_batch: int | None = None, writer: str = DEFAULT_WRITER) -> DataFrame:
        """Stored postings; with ``before_batch`` without that and later batches of ``writer``.

        ``writer`` and ``batch`` are partition columns, so the condition prunes folders.
        """
        if not self.writers():
            return self.spark.createDataFrame([], _READ_SCHEMA)
        df = self.spark.read.schema(_READ_SCHEMA).parquet(self.current())
        if before_batch is not None:
            df = df.where((F.col("writer") != writer) | (F.col("batch") < before_batch))
        return unsink_text(df)

    def append(self, df: DataFrame, batch: int | None = None, writer: str = DEFAULT_WRITER) -> int:
        """Add postings as one batch of a writer; the same number replaces itself."""
        if batch is None:
            batch = max(self.batches(writer), default=-1) + 1
        # the old keys go first: a batch without an index is indexed when somebody asks for it
        self._delete(self._index(writer, batch))
        sink_text(conform(df, [ARRIVAL, *OUTPUT_COLUMNS])).write.mode("overwrite").parquet(
            f"{self.current()}/writer={writer}/batch={batch}"
        )
        self._indexed(writer, batch)
        return batch

    def outputs(self, model: str | None) -> str | None:
        """The folder for the outputs of a named model."""
        return None if model is None else f"{self.root}/outputs/model={model}"

    # -- keys ----------------------------------------------------------------

    def _index(self, writer: str, batch: int) -> str:
        return f"{self.root}/index/{self.current().rsplit('/', 1)[1]}/writer={writer}/batch={batch}"

    def _indexed(self, writer: str, batch: int) -> str:
        """The folder of a batch's key index, written now if it is not there."""
        folder = self._index(writer, batch)
        if not self._fs().exists(self._path(f"{folder}/filters/_SUCCESS")):
            stored = self.spark.read.schema(STORED).parquet(f"{self.current()}/writer={writer}/batch={batch}")
            key_index.write(unsink_text(stored), folder)
        return folder

    def met(self, new: DataFrame, before_batch: int | None = None, writer: str = DEFAULT_WRITER) -> DataFrame:
        """Of the keys of ``new`` postings, those that are stored, as rows ``(url, title, company)``.

        Looks into the key index only; ``before_batch`` is that of ``read``.
        """
        folders = [
            self._indexed(w, b) for w in self.writers() for b in self.batches(w)
            if before_batch is None or w != writer or b < before_batch]
        return key_index.met_keys(new, folders, Scratch(self.spark, "met"))

    # -- notes beside the batches of a writer that ingests one run in parts ---------

    def _notes(self, kind: str, writer: str) -> str:
        return f"{self.root}/notes/{kind}/writer={writer}"

    def _noted(self, kind: str, before_batch: int, writer: str) -> list[int]:
        names = [n.split("=", 1)[1] for n in self._children(self._notes(kind, writer)) if n.startswith("batch=")]
        return sorted(int(n) for n in names if int(n) < before_batch)

    def remember(self, memory: DataFrame, met: DataFrame, batch: int, writer: str = DEFAULT_WRITER) -> None:
        """Note what is known of each session after a batch: of those it ``met``, now and then of all."""
        whole = batch % WHOLE_MEMORY == 0
        if not whole:
            memory = memory.join(met.select("layout", "session").distinct().withColumnsRenamed(
                {"layout": "_layout", "session": "_session"}),
                (F.col("layout") == F.col("_layout")) & F.col("session").eqNullSafe(F.col("_session")), "left_semi")
        path = f"{self._notes('whole' if whole else 'met', writer)}/batch={batch}"
        memory.select(*MEMORY.names).write.mode("overwrite").parquet(path)

    def memory(self, before_batch: int, writer: str = DEFAULT_WRITER) -> DataFrame:
        """``(layout, session, digest, stale)`` as the batches below ``before_batch`` left it."""
        whole = self._noted("whole", before_batch, writer)[-1:]
        later = [n for n in self._noted("met", before_batch, writer) if not whole or n > whole[0]]
        paths = [f"{self._notes(kind, writer)}/batch={n}" for kind, found in (("whole", whole), ("met", later)) for n in found]
        if not paths:
            return self.spark.createDataFrame([], MEMORY)
        notes = None
        for path in paths:
            part = self.spark.read.schema(MEMORY).parquet(path).withColumn(
                "batch", F.lit(int(path.rsplit("=", 1)[1])).cast("long"))
            notes = part if notes is None else notes.unionByName(part)
        last = F.max_by(F.struct("digest", "stale"), "batch").alias("m")
        return notes.groupBy("layout", "session").agg(last).select("layout", "session", "m.digest", "m.stale")

    def rows_of(self, batch: int, writer: str = DEFAULT_WRITER) -> int:
        return self.spark.read.schema(STORED).parquet(f"{self.current()}/writer={writer}/batch={batch}").count()

    def note_admitted(self, total: int, batch: int, writer: str = DEFAULT_WRITER) -> None:
        """Note how many rows a run has admitted up to and with a batch."""
        self.spark.createDataFrame([(total,)], "total long").coalesce(1).write.mode("overwrite").parquet(
            f"{self._notes('admitted', writer)}/batch={batch}")

    def admitted(self, before_batch: int, writer: str = DEFAULT_WRITER) -> int:
        """How many rows a run admitted in the batches below ``before_batch``."""
        found = self._noted("admitted", before_batch, writer)
        return self.spark.read.parquet(f"{self._notes('admitted', writer)}/batch={found[-1]}").first()[0] if found else 0

    def replace(self, clean: DataFrame) -> str:
        """Make ``clean`` the stored postings, as a new version."""
        version = self._version_path(max(self._versions(), default=0) + 1)
        first = {"writer": F.lit(DEFAULT_WRITER), "batch": F.lit(0).cast("long")}
        df = clean.withColumns({c: first[c] for c in _PLACE if c not in clean.columns})
        sink_text(conform(df, [ARRIVAL, *OUTPUT_COLUMNS, *_PLACE])).write.mode("overwrite").partitionBy(
            *_PLACE).parquet(version)
        return version

    def replace_with_backup(self, flagged: DataFrame) -> dict[str, int]:
        """Keep the rows with ``is_valid``; back up all rows if any is removed.

        Writes nothing when every row is valid. Returns the row counts.
        """
        counts = flagged.agg(
            F.count(F.lit(1)).alias("original"), F.count_if("is_valid").alias("kept"),
        ).first().asDict()
        counts["removed"] = counts["original"] - counts["kept"]
        if counts["removed"]:
            backup = f"{self.root}/backup-{self.current().rsplit('/', 1)[1]}"
            sink_text(flagged).write.mode("overwrite").parquet(backup)
            # the backup holds the verdicts, so the clean rows come from it
            saved = unsink_text(self.spark.read.schema(flagged.schema).parquet(backup))
            self.replace(saved.where("is_valid").drop("is_valid"))
        return counts
