"""Streams of edits and messages: quiet-gap debounce, latest state per field, checked micro-batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozgar.operators.spelling import SpellChecker

DEBOUNCE_PAGE, DEBOUNCE_DOCUMENT = "600 milliseconds", "900 milliseconds"
POLL_EVERY, POLL_SECONDS = "300 milliseconds", 15.0


def debounced(edits: DataFrame, field: str = "field", ts: str = "ts", text: str = "text", gap: str = DEBOUNCE_PAGE, late: str | None = None) -> DataFrame:
    """(field, at, text): the last text of each run of edits that a quiet gap ends; works on streams and tables.

    On a stream, results come when the watermark (``late``, the gap by default) has passed the gap.
    """
    rows = edits.withWatermark(ts, late or gap) if edits.isStreaming else edits
    sessions = rows.groupBy(field, F.session_window(ts, gap).alias("quiet")).agg(F.max(ts).alias("at"), F.max_by(text, F.struct(ts, text)).alias("text"))
    return sessions.select(field, "at", "text")


def latest(edits: DataFrame, field: str = "field", ts: str = "ts", text: str = "text") -> DataFrame:
    """(field, at, text): the newest text of each field; on a stream kept as state (update or complete mode)."""
    return edits.groupBy(field).agg(F.max(ts).alias("at"), F.max_by(text, F.struct(ts, text)).alias("text"))


def check_batches(messages: DataFrame, checker: SpellChecker, sink: Callable[[DataFrame, int], None], keys: list[str], text: str = "text", top_n: int = 3):
    """A stream writer that checks each micro-batch and hands the results to ``sink(results, batch_id)``.

    Ranking needs a window over all candidates of a word, which streams allow only inside a micro-batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sink(checker.check(batch, keys, text, top_n, spans=True), number)
        finally:
            batch.unpersist()
            checker.forget()

    return messages.writeStream.foreachBatch(handle)


def counted_words(lines: DataFrame, words) -> DataFrame:
    """(word, freq) of a stream of lines; run it in complete or update mode."""
    return lines.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def poll(rows: DataFrame, sink: Callable[[DataFrame, int], None], every: str = POLL_EVERY, give_up: float = POLL_SECONDS) -> bool:
    """Looks at a stream ``every`` so often until rows come and hands that first batch to ``sink(rows, batch_id)``.

    Returns whether rows came within ``give_up`` seconds. A batch that has come in time is finished, however long it takes; later
    batches are left alone. What fails in the stream or in ``sink`` is raised.
    """
    came, done = threading.Event(), threading.Event()

    def handle(batch: DataFrame, number: int) -> None:
        if not came.is_set() and not batch.isEmpty():
            came.set()
            sink(batch, number)
            done.set()

    until = time.monotonic() + give_up
    running = rows.writeStream.foreachBatch(handle).trigger(processingTime=every).start()
    try:
        while running.isActive and not done.wait(0.05):
            if not came.is_set() and time.monotonic() > until:
                break
        if failure := running.exception():
            raise failure
        return done.is_set()
    finally:
        running.stop()
