"""Result documents are written by many tasks, however few bytes they have."""

import glob
import re

from pyspark.sql import functions as F

from quarry.plans import results as R
from quarry.sinks.files import write_document_folders


def test_documents_of_a_small_aggregate_are_dealt_to_tasks(spark, tmpdir_fresh):
    docs = spark.range(240).groupBy(F.concat(F.lit("m"), F.col("id")).alias("model"), (F.col("id") % 3).cast("string").alias("split")).agg(
        F.struct(F.struct(F.count(F.lit(1)).alias("total_tasks")).alias("summary")).alias("doc"))
    root = write_document_folders(docs, f"{tmpdir_fresh}/docs", ["split", "model"])
    found = [re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{root}/*/*/part-*")]
    assert len(found) == 240 and len(set(found)) > 1
    assert max(found.count(x) for x in set(found)) < 240 / 4  # eight tasks on four cores
    back = R.collect_grid_documents(spark, root, glob="part-*")
    assert back.count() == 240 and back.agg(F.sum("total")).first()[0] == 240
