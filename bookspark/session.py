"""Session helpers shared by every operator; nothing here keeps state."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bookspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, ``master`` stays None and the submit command decides.
    AQE coalesces the generous shuffle partition count by size.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that their Python workers can import it.

    Spark's own file server hands the archive out; executors that join later get it as well.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bookspark-code-")) / "bookspark_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read lazily."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the folder the cluster names.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset a
    local session, as in tests, gets a temporary one; a cluster is refused, as
    no folder of one machine would do there.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="bookspark-checkpoint-"))
    return df.checkpoint()


_FILES: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to the executors, once per application; its name there."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _FILES:
        sc.addFile(path)
        _FILES.add((sc.applicationId, path))
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Place of a shipped file on the machine that asks."""
    return SparkFiles.get(name)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file; BOOKSPARK_TOKENIZERS overrides the folder."""
    return os.path.join(os.environ.get("BOOKSPARK_TOKENIZERS", "/opt/tokenizers"), name)
