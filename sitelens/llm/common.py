"""Session and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import pathlib
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy pass holds; longer texts form a pass of their own.
SLICE_BYTES = 1 << 20
# Rows of one pass: their ordinals must fit the 12 bits that textops packs.
SLICE_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The frame's session; its Python workers get this package, wherever
    they start, as a zip that Spark ships."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not getattr(sc, "_llm_shipped", False):
        top = pathlib.Path(__file__).resolve().parent.parent
        name = pathlib.Path(tempfile.mkdtemp(prefix="llm-py-")) / f"{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in [top / "__init__.py", *(top / "llm").glob("*.py")]:
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(name))
        sc._llm_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a scratch one only for
    a local session that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            current = tempfile.mkdtemp(prefix="llm-ckpt-")
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def buckets(spark: SparkSession, least: int = 64) -> int:
    """Hash buckets of a packed exchange: as many as shuffle partitions, so
    that a bucket's share shrinks as the session is sized for larger input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column(df: DataFrame, source: str, name: str, kind: str):
    """``source`` as ``name`` of type ``kind``; left untouched where it is that
    already, so that equal exchanges over it compare as equal and are reused."""
    c = F.col(f"`{source}`")
    if df.schema[source].dataType.simpleString() != kind:
        c = c.cast(kind)
    elif source == name:
        return c
    return c.alias(name)


def release() -> None:
    """Give freed memory back: Python workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def frees(fn):
    """``fn`` of one group's frame, with its memory given back afterwards."""
    def run(pdf):
        try:
            return fn(pdf)
        finally:
            release()
    return run


def packed(df: DataFrame, text: str, out: str, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(row, text): the columns to carry through Python as one struct, so that
    no name clashes, and the text.  ``carry`` None: all columns but ``out``."""
    names = [c for c in df.columns if c != out] if carry is None else list(carry)
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return df.select(row.alias("row"), column(df, text, "text", "string"))


def unpacked(df: DataFrame, value: str, out: str) -> DataFrame:
    """The carried columns and ``value`` as ``out``."""
    return df.select("row.*", F.col(value).alias(out))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of the batches with their texts as bytes (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        lens = [0 if not v.is_valid else len(v.as_buffer()) for v in col]
        at = 0
        while at < len(lens):
            end, size = at, 0
            while end < len(lens) and end - at < SLICE_ROWS and (end == at or size + lens[end] <= max_bytes):
                size += lens[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in col.slice(at, end - at).to_pylist()]
            at = end
    release()
