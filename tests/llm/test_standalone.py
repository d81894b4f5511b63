"""Operators called directly, each first in a session whose workers don't have the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys, tempfile
sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession, functions as F
from vaultsieve.llm import embedding_dedup, filter_audit, html, importance, minhash, mixing, neighbours, packing, quality, substrings, suffixes, toxicity, url_filter
from vaultsieve.llm.queries import tokenizer_path

docs = lambda s: s.createDataFrame([(i, "a few words of text " * i, "x") for i in range(9)], "doc_id long, text string, source string")
vectors = lambda s: s.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<double>")
calls = [
    lambda s: mixing.mix_sources(docs(s)), lambda s: minhash.near_duplicates(docs(s)), lambda s: substrings.dedup_substrings(docs(s)),
    lambda s: suffixes.dedup_bytes(docs(s)), lambda s: quality.score(docs(s)), lambda s: packing.pack(docs(s), tokenizer_path()),
    lambda s: toxicity.score(docs(s), s.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")),
    lambda s: html.main_text(s.createDataFrame([(1, "http://a/", "<p>a b")], "page_id long, url string, html string")),
    lambda s: neighbours.nearest(vectors(s), F.col("vec_id") % 20 == 0), lambda s: embedding_dedup.duplicate_vectors(vectors(s)),
    lambda s: importance.resample(docs(s), docs(s)), lambda s: url_filter.judge(s.createDataFrame([(1, "http://a/")], "page_id long, url string")),
    lambda s: filter_audit.audit(docs(s), s.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")),
]
for call in calls:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    assert call(spark).count() > 0
    spark.stop()
print("all", len(calls))
"""


def test_each_operator_called_first_without_the_package_on_the_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    keep = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT]
    env |= {"PYTHONPATH": ":".join(keep)} if keep else {}
    done = subprocess.run([sys.executable, "-c", f"ROOT = {str(ROOT)!r}\n{SCRIPT}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("all 13"), done.stderr[-3000:]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    import pytest

    from vaultsieve.llm import common

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return Session.sparkContext._jsc

                @staticmethod
                def getCheckpointDir():  # noqa: N802
                    return Session.sparkContext._jsc

                @staticmethod
                def isDefined():  # noqa: N802
                    return False

            @staticmethod
            def getConf():  # noqa: N802
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)
