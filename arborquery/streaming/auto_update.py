"""Updates an index again and again: a timer made of a stream's trigger, each micro-batch one update."""

from __future__ import annotations

import logging
import uuid

from ..engine import Engine
from ..shared import remove, shared_dir

_log = logging.getLogger(__name__)


class AutoUpdate:
    """with AutoUpdate(engine, seconds): ... ; errors are logged, the next turn tries again."""

    def __init__(self, engine: Engine, seconds: float, immediate: bool = True, settings_path: str | None = None):
        self.engine, self.seconds, self.immediate, self.settings_path = engine, seconds, immediate, settings_path
        self.updates = 0
        self._skip = not immediate
        self._query = None

    def _turn(self, _batch, _number: int) -> None:
        if self._skip:
            self._skip = False
            return
        try:
            if self.settings_path:
                self.engine.settings = type(self.engine.settings).load(self.settings_path)
            self.engine.update()
            self.updates += 1
        except Exception:
            _log.exception("the index could not be updated")

    def start(self) -> AutoUpdate:
        self._place = f"{shared_dir(self.engine.spark)}/auto-update-{uuid.uuid4().hex}"
        ticks = self.engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self._query = ticks.writeStream.trigger(processingTime=f"{max(1, round(self.seconds * 1000))} milliseconds").option("checkpointLocation", self._place).foreachBatch(self._turn).start()
        return self

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None
            remove(self.engine.spark, self._place)

    def __enter__(self) -> AutoUpdate:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()
