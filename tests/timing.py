"""Seconds per registered query on Spark alone.

    python tests/timing.py sf_dir [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

if __name__ == "__main__":
    import __spark_entry__ as entry
    from abacist.session import build

    sf_dir = sys.argv[1]
    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = entry.queries()
    todo["dau"](spark, sf_dir).collect()
    for name in sys.argv[2:] or todo:
        start = time.time()
        todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"{name:32s} {time.time() - start:6.2f}s", flush=True)
