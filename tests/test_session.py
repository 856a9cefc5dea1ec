"""What a session of its own shows of the driver."""

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from peergraph import session

MANY = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from peergraph import session

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
session.shared_dir(spark)
rows = spark.range(10).withColumn("k", F.col("id") % 3)
found = rows.groupBy("k").count()
for i in range(49):
    found = found.unionByName(rows.groupBy((F.col("k") + i).alias("k")).count())
print("ROWS", session.cut(found).count())
names = [t.getName() for t in spark._jvm.Thread.getAllStackTraces().keySet()]
print("THREADS", sum(n.startswith("shuffle-exchange") for n in names), session.STARTERS)
"""


def test_few_threads_start_shuffles():
    said = subprocess.run([sys.executable, "-c", MANY], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300).stdout
    said = dict(line.split(" ", 1) for line in said.splitlines() if line.startswith(("ROWS", "THREADS")))
    threads, most = map(int, said["THREADS"].split())
    assert said["ROWS"] == "150"
    assert 0 < threads <= most


def test_files_of_shuffles_go_with_a_cut(spark):
    """The files of what made a checkpoint go while the plan is still referred to, and a setting of the session's own stays."""
    folders = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def files():
        return {f.name for d in folders for f in d.rglob("shuffle_*")}

    before = files()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k")
    assert spark.conf.get(session.DROP_FILES) == "false"
    found = session.cut(rows)
    assert spark.conf.get(session.DROP_FILES) == "false"
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


GROWN = """
import time
from pyspark.sql import SparkSession
from peergraph import session

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "512m").getOrCreate()
heap = spark._jvm.java.lang.Runtime.getRuntime()
held = []
while 2 * heap.totalMemory() <= heap.maxMemory():
    held.append(spark._jvm.java.nio.ByteBuffer.allocate(16 << 20))
del held
for _ in range(20):  # the JVM lets go of what Python held a little later
    session.give_back(spark)
    if 2 * heap.totalMemory() <= heap.maxMemory():
        break
    time.sleep(0.2)
print("SHARE", heap.totalMemory() / heap.maxMemory())
"""


def test_heap_that_has_grown_shrinks():
    said = subprocess.run([sys.executable, "-c", GROWN], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300).stdout
    assert 0 < float(said.split("SHARE", 1)[1]) <= 0.5


def test_cuts_give_memory_back_on_a_cluster(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "give_back", asked.append)
    session.cut(spark.range(3))
    assert not asked  # the heap of local mode is the executors' too
    monkeypatch.setattr(session, "is_local", lambda spark: False)
    session.cut(spark.range(3))
    assert asked == [spark]
