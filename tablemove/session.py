"""Session-level helpers: where scratch data lives, and name generation.

Everything this library writes outside a user-named table goes below the
shared folder the cluster names in ``spark.checkpoint.dir``. Library code
never invents a machine-local folder; only callers that run without a
cluster setting (tests, the local driver contract) may set one first, via
:func:`ensure_checkpoint_dir`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``, or ``None``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    try:
        found = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a Connect session)
        return None
    return found.rstrip("/") if found else None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a local one only when unset.

    Intended for tests and single-machine runs; on a cluster the setting is
    present and is used as is.
    """
    root = checkpoint_root(spark)
    if root is None:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir is not set on {master}; name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tablemove-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        try:
            spark.sparkContext.setCheckpointDir(root)
        except Exception:  # noqa: BLE001 - no SparkContext (e.g. a Connect session)
            pass
    return root


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if root is None:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for "
            "scratch data (tests may call ensure_checkpoint_dir first)"
        )
    leaf = "/".join(p.strip("/") for p in parts if p)
    unique = uuid.uuid4().hex[:12]
    return f"{root}/tablemove/{leaf}-{unique}" if leaf else f"{root}/tablemove/{unique}"


def unique_name(prefix: str) -> str:
    """A valid, unique identifier such as ``tm_3f2a9c1b``."""
    return f"{prefix}_{uuid.uuid4().hex[:10]}"
