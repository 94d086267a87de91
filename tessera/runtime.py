"""Session helpers: shared folder, written intermediate tables, table reading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application.

    Python stages import it by name; executors elsewhere, or with another working
    folder, would not find it.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera-package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """A folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, notebooks) a local folder is used.
    What is written below it is removed when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/tessera-{app}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet into the shared folder and read it back.

    Cuts the lineage and lets several branches read one computation; the files
    survive the loss of executors.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side is broadcast up to this size in memory; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def held_bytes(df: DataFrame) -> Column:
    """About the bytes that a row of df takes in memory."""
    size = F.lit(24)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map"):
            size = size + 24 + F.greatest(F.size(c), F.lit(0)) * 32
        else:
            size = size + 8
    return size


def broadcast_below(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """(df with a broadcast hint if its rows take at most ``most_bytes``, else unhinted; its number of rows).

    ``df`` should be narrow and cheap (a written table): its rows are measured once.
    """
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(held_bytes(df)), F.lit(0))).first()
    return (F.broadcast(df) if size <= most_bytes else df), n


def parts_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions for ``size`` bytes to shuffle: no fewer than the session's, and about ``each`` bytes in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 200_000))


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads (a written table)."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return size


def latest(df: DataFrame, key: str, stamp: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per ``key``: the delivery with the greatest ``stamp``.

    A narrow pass finds the repeated keys; only those are joined back, so wide
    columns are not shuffled (repeated keys are broadcast up to
    ``broadcast_bytes`` and joined by shuffle beyond). Rows with a null key
    are dropped; a null stamp is the least; of rows that tie on the stamp the one
    with the greatest hash over all columns is kept, so the result is repeatable.
    """
    known = df.where(F.col(key).isNotNull())
    narrow = known.select(F.col(key).alias("__k"), F.col(stamp).alias("__s"))
    repeated = narrow.groupBy("__k").agg(F.count("*").alias("__n"), F.max("__s").alias("__m")).where("__n > 1")
    repeated = materialise(repeated.select("__k", "__m"), "repeated")
    side, _ = broadcast_below(repeated, broadcast_bytes)
    joined = known.join(side, F.col(key) == F.col("__k"), "left")
    single = joined.where("__k is null").select(*df.columns)
    again = joined.where(F.col("__k").isNotNull() & F.col(stamp).eqNullSafe(F.col("__m"))).select(*df.columns)
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    one = again.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("__r")).select("__r.*")
    return single.unionByName(one)


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """df over all cores, if ``scan``, the table it was read from, is so small that fewer tasks read it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan.rdd.getNumPartitions() < cores else df


def blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | F.trim(c).eqNullSafe("")
