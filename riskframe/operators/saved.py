"""Fitted stages as members of saved Spark ML pipelines.

A stage keeps its parameters in Spark ML's own metadata and its fitted state beside
it, so ``PipelineModel.load`` in any process that has this package gives the stages
back, Spark's own stages among them.
"""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class StateWriter(MLWriter):
    """Metadata of a stage, then whatever its ``save_state(spark, path)`` writes."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.save_state(self.sparkSession, path)


class StateReader(MLReader):
    """A stage from ``load_state(spark, path)``, with the uid and the parameters it was saved with."""

    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.kind.load_state(spark, path)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class Stateful(MLWritable, MLReadable):
    """A fitted stage with ``save_state`` and ``load_state``; ``save`` replaces what is at the path."""

    def write(self) -> MLWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StateReader(cls)

    def save(self, path: str) -> None:
        self.write().overwrite().save(path)
