import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with what tables hold in practice: nulls, empties, ties, repeats, clashing extra columns."""
    import random

    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "the", "of", "naïve", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(60)
    rows = [(i, text(r.randint(1, 80)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, base, "s0") for i in range(40)]
    rows += [(200 + i, base + " " + text(1), "s0") for i in range(12)]
    rows += [(300, None, None), (301, "", "s1"), (302, " \t ", "s1"), (303, "  a\nb  ", None), (304, " a b ", "s2"), (None, base, "s2"), (None, "only null id", "s2"), (5, "same id again", "s9"), (305, text(4000), "s1"), (306, text(4000) + " " * 3000, "s1"), (307, "z" * 50000, "s1"), (308, "z" * 50000, "s1"), (309, "z" * 50001, "s1")]
    rows += [rows[0], rows[0]]
    frame = spark.createDataFrame([(*x, "n", 1, 2) for x in rows], "doc_id long, text string, source string, TEXT string, uid int, size int")
    path = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"declgraph-docs-{os.getpid()}")
    frame.toDF("doc_id", "text", "source", "t2", "uid", "size").repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumnRenamed("t2", "name")
