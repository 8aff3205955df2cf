"""hearthframe: Spark-native analytics for housing markets and small-area affordability."""

__version__ = "0.1.0"


def importable_by_workers(spark) -> None:
    """Lets Python workers on this machine import the package from where it lies; on a cluster it is shipped (--py-files)."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. Only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="hearthframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")
