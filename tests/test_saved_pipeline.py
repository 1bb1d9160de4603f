"""A saved pipeline of preprocessor and model: loaded by another process, and by a stream."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import linear as L
from riskframe.operators import prep as P
from riskframe.sources.applicants import applicants

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

OTHER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.ml import PipelineModel
from riskframe.session import local_session
spark = local_session(cores=2, shuffle_partitions=2)
m = PipelineModel.load(sys.argv[2])
rows = m.transform(spark.read.parquet(sys.argv[3])).select("{id}", "score").orderBy("{id}").collect()
print("SUM", len(rows), repr(sum(r[1] for r in rows)), m.stages[0].getOrDefault("smoothing"), m.stages[1].getOrDefault("predictionCol"))
""".format(id=C.ID)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("saved")
    a = applicants(spark, SF)
    a.write.parquet(str(folder / "applicants"))
    a = spark.read.parquet(str(folder / "applicants"))
    m = Pipeline(stages=[P.RiskPreprocessor(smoothing=4.0), L.LogLinearRegression(predictionCol="score", pvalueThreshold=0.01)]).fit(a.where(F.col(C.SPLIT) == C.TRAIN))
    m.write().save(str(folder / "model"))
    return folder, a, m


def scores(df):
    return {r[0]: r[1] for r in df.select(C.ID, "score").collect()}


def test_loaded_pipeline_scores_as_the_fitted_one(saved):
    folder, a, m = saved
    again = PipelineModel.load(str(folder / "model"))
    assert scores(again.transform(a)) == scores(m.transform(a))
    assert [s.uid for s in again.stages] == [s.uid for s in m.stages]
    assert again.stages[1].linear.features == m.stages[1].linear.features and again.stages[1].getOrDefault("pvalueThreshold") == 0.01
    unfitted = Pipeline(stages=[P.RiskPreprocessor(smoothing=4.0), L.LogLinearRegression(predictionCol="score")])
    unfitted.write().save(str(folder / "plan"))
    plan = Pipeline.load(str(folder / "plan"))
    assert plan.getStages()[0].getOrDefault("smoothing") == 4.0 and plan.getStages()[1].getOrDefault("predictionCol") == "score"


def test_another_process_loads_it(saved):
    folder, a, m = saved
    done = subprocess.run([sys.executable, "-c", OTHER, ROOT, str(folder / "model"), str(folder / "applicants")], capture_output=True, text=True, timeout=300)
    said = [x for x in done.stdout.splitlines() if x.startswith("SUM")]
    assert said, done.stderr[-2000:]
    want = scores(m.transform(a))
    _, n, total, smoothing, out = said[0].split()
    assert int(n) == len(want) and float(total) == pytest.approx(sum(want.values())) and (float(smoothing), out) == (4.0, "score")


def test_a_stream_scores_with_it(spark, saved):
    folder, a, m = saved
    stream = spark.readStream.schema(a.schema).parquet(str(folder / "applicants"))
    scored = PipelineModel.load(str(folder / "model")).transform(stream).select(C.ID, "score")
    out = str(folder / "scored")
    q = scored.writeStream.format("parquet").option("checkpointLocation", str(folder / "offsets")).trigger(availableNow=True).start(out)
    q.awaitTermination(300)
    assert scores(spark.read.parquet(out)) == scores(m.transform(a))
