"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.session import checkpoint_dir

#: Rows handled together inside a Python task. Texts vary from a few bytes to many MB, so
#: batches are cut by bytes as well (see ``slices``).
ROWS_AT_ONCE = 2048
BYTES_AT_ONCE = 4 << 20
#: For work that takes many times the bytes of its texts (every word as a string, figures of each n-gram or token).
FEW_BYTES_AT_ONCE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quillstat-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage,
    so later jobs neither repeat the work nor depend on executors that may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds a bounded number of rows and text bytes
    (a single longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(text)
        if i < 0:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and (row - start >= ROWS_AT_ONCE or held + size > most):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores put before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Column names as they are, dots and backquotes in them included."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def map_text(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable],
             keep_text: bool = False, most: int = BYTES_AT_ONCE) -> DataFrame:
    """``df.select(columns)`` through ``mapInArrow``. ``make()`` runs once per task and returns
    a function from a list of texts (null as None) to a dict of new column name -> list or
    Arrow array; the other selected columns (with ``keep_text`` the text too) pass unchanged.
    It gets texts of at most ``most`` bytes at once (a longer one alone).

    ``schema`` is the DDL of the new columns."""
    from pyspark.sql.types import StructType

    picked = df.select(*quoted(columns))
    keep = [c for c in columns if keep_text or c != "text"]
    at = {c: i for i, c in enumerate(columns)}
    # mapInArrow takes no names with dots: columns go in by place, and get their names back from its schema
    placed = picked.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(columns)])
    new = StructType.fromDDL(schema)
    out = StructType([picked.schema[c] for c in keep] + new.fields)
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        work = make()
        for part in slices(batches, most=most):
            made = work(part.column(at["text"]).to_pylist())
            arrays = [part.column(at[c]) for c in keep] + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) and a.type == f.type else
                 (a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type))
                 for a, f in zip(arrays, target)], schema=target)

    return placed.mapInArrow(run, out)


def cpu_partitions(df: DataFrame) -> int:
    """Partitions for CPU-heavy work: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_partitions(df: DataFrame) -> int:
    """Partitions that ``df`` comes in (a remote session: the session's shuffle partitions)."""
    try:
        return max(1, df.rdd.getNumPartitions())
    except Exception:  # remote session: it has no RDDs
        return cpu_partitions(df)


def text_hash(column: str = "text"):
    """64-bit hash of a text, null as empty: tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def let(value, body: Callable):
    """``body`` of a column that is worked out once: a one-element array's transform binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)
