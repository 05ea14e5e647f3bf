import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from dijkstone.llm import embeddings, language, pieces, simhash, similar, substring_dedup, toxicity
from dijkstone.llm.queries import VOCABULARY
docs = spark.createDataFrame([(i, "some words of text " + "ab cd ef gh ij " * 9, "en") for i in range(8)], "doc_id long, text string, lang string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
n = toxicity.score(docs, toxicity.fit(docs, labels)).count() + language.predict(docs, language.fit(docs)).count()
n += pieces.round_trip(docs, pieces.Vocabulary.load(VOCABULARY)).where("exact").count()
n += substring_dedup.remove_repeats(docs).where("n_removed = n_words").count()
n += simhash.near_duplicates(docs).where("component_id = 0").count() + similar.keep_one_of_each(docs).count()
vectors = docs.selectExpr("doc_id as vec_id", "array(1.0, 2.0) as embedding", "1 as label")
n += embeddings.near_duplicates(vectors).where("n_links = 7").count()
print("DONE", n)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers find neither the folder of the package nor PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "job.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "DONE 48" in done.stdout, done.stderr[-3000:]
