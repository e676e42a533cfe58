"""Written intermediates in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable
from pathlib import Path
from tempfile import NamedTemporaryFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import keepsake
from keepsake.storage import discard as discard_path
from keepsake.storage import new_path

_shipped: set[str] = set()
#: Written tables that may be discarded, with their folders.
_paths: dict[int, tuple[DataFrame, str]] = {}
#: What the operators of one worker remember: how to empty it, by name.
_memories: dict[str, list[Callable[[], None]]] = {}
_in_use: list[str] = [""]
#: Rows of the batches that Spark hands to Python where the session keeps its default of 10,000.
BATCH_ROWS = 2000


def memory(name: str, clear: Callable[[], None]) -> None:
    _memories.setdefault(name, []).append(clear)


def use_memory(name: str) -> None:
    """Workers outlive a stage: empty what other operators remember, and hand free memory back."""
    if _in_use[0] == name:
        return
    _in_use[0] = name
    for other, clears in _memories.items():
        if other != name:
            for clear in clears:
                clear()
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def ship_package(spark: SparkSession) -> None:
    """Hand the package's modules to the workers, once per application, as Spark ships files
    of a job; they need not have it installed."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # texts are long: smaller batches, unless the session has its own
        spark.conf.set(rows, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, packed = Path(keepsake.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"keepsake/{file.relative_to(root)}")
    with NamedTemporaryFile(prefix="keepsake-", suffix=".zip", delete=False) as out:  # on the driver; Spark copies it
        out.write(packed.getvalue())
    context.addPyFile(out.name)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write once to the shared folder and reread; every later use starts from the files."""
    ship_package(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` of which all consumers are written themselves."""
    for table_ in tables:
        _, path = _paths.pop(id(table_))
        discard_path(table_.sparkSession, path)


def spread_parts(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Parts for evenly dealt work: enough for all shuffle tasks and for bounded parts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part), 1)


def fill_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
