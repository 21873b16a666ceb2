"""Continuous discovery: landed search pages to deck stubs to the stored decks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from deckspark.operators.paging import SWEEP, cut_landed
from deckspark.operators.stubs import fold_stubs, parse_stubs, upsert_stubs
from deckspark.schemas import CORRUPT
from deckspark.sources.keyed import KeyedTable
from deckspark.sources.snapshots import SnapshotTable
from deckspark.streaming.logs import BatchLog, start_bound


class StubSink:
    """``foreachBatch`` target: log the stubs of each batch and merge them every so often.

    Logging costs as much as the batch is large. Merging rewrites the buckets of
    the deck table that the batch touches, all of them if the batch is large, so it may
    wait for several batches; the result is the same. Version v of the decks holds the batches below v, hence a repeated
    batch reads the version before it and writes the same one again.
    """

    def __init__(
        self,
        decks: SnapshotTable | KeyedTable,
        log: BatchLog,
        broken: str,
        merge_every: int = 1,
        sweeps: KeyedTable | None = None,
        finished: Callable[[DataFrame, int], object] | None = None,
    ):
        self.decks, self.log, self.broken, self.merge_every = decks, log, broken, merge_every
        self.sweeps, self.finished = sweeps, finished

    def __call__(self, stubs: DataFrame, batch_id: int) -> None:
        self.log.put(stubs, batch_id)
        if (batch_id + 1) % self.merge_every == 0:
            self.merge(batch_id + 1)

    def merge(self, version: int) -> None:
        """Bring the decks up to date with all batches below ``version``: only the buckets they touch."""
        merged = self.decks.latest(below=version) or 0
        waiting = self.log.read(merged, version)
        touched = self.decks.touched(waiting, below=version)
        stored = self.decks.read(below=version, buckets=touched)
        current = upsert_stubs(stored, fold_stubs(waiting)).select(*stored.columns)
        self.decks.write(current, version, buckets=touched)

    def finish(self) -> None:
        """Merge what still waits; for the end of a run."""
        end = self.log.end()
        if (self.decks.latest() or 0) < end:
            self.merge(end)

    def take_pages(self, pages: DataFrame, batch_id: int) -> None:
        """The same for raw pages; pages without a landing number, or no valid JSON, are set aside as text."""
        pages = pages.persist()
        try:
            usable = F.col(CORRUPT).isNull() & F.col("seq").isNotNull()
            text = F.coalesce(CORRUPT, F.to_json(F.struct(*[c for c in pages.columns if c != CORRUPT])))
            broken = pages.filter(~usable).select(text.alias(CORRUPT), "seq")
            broken.write.mode("overwrite").parquet(f"{self.broken}/batch={batch_id}")
            taken = pages.filter(usable)
            if self.sweeps is None:
                self(parse_stubs(taken), batch_id)
            else:
                self.take_sweeps(taken, batch_id)
        finally:
            pages.unpersist()


    def take_sweeps(self, pages: DataFrame, batch_id: int) -> None:
        """Log the stubs of the pages that their sweeps reach; say which sweeps are finished.

        Where the sweeps stand is kept as version ``batch_id + 1`` of their table, so a repeated batch
        cuts as before. It asks which decks are stored, so the batches before it are merged first.
        Pages that do not say which sweep and page they are are read without a cut.
        """
        if (self.decks.latest(below=batch_id + 1) or 0) < batch_id:
            self.merge(batch_id)
        placed = F.col("card_name").isNotNull() & F.col("format").isNotNull() & F.col("page").isNotNull()
        stubs, stray = parse_stubs(pages.filter(placed)), parse_stubs(pages.filter(~placed))
        names = pages.filter(placed).select(F.col("card_name").alias("sweep_card"), F.col("format").alias("sweep_format"))
        touched = self.sweeps.touched(names, below=batch_id + 1)
        state = self.sweeps.read(below=batch_id + 1, buckets=touched)
        known = self.decks.read(below=batch_id + 1, buckets=self.decks.touched(stubs, below=batch_id + 1))
        cut = cut_landed(pages.filter(placed), stubs, known, state)
        self(stubs.join(cut.kept, [*SWEEP, "seq", "page"], "left_semi").unionByName(stray), batch_id)
        others = state.join(cut.state.select(*SWEEP), SWEEP, "left_anti")
        self.sweeps.write(others.unionByName(cut.state.select(*state.columns)), batch_id + 1, buckets=touched)
        if self.finished is not None:
            self.finished(cut.finished, batch_id)


def start_stubs(stubs: DataFrame, sink: StubSink, checkpoint: str, once: bool = True, adopt: bool = False) -> StreamingQuery:
    """Run a stream of parsed stubs into the sink; ``once`` stops at the end of what has landed."""
    return start_bound(stubs, sink, sink.log, checkpoint, once, adopt)


def start_discovery(pages: DataFrame, sink: StubSink, checkpoint: str, once: bool = True, adopt: bool = False) -> StreamingQuery:
    """The same for a stream of landed pages."""
    return start_bound(pages, sink.take_pages, sink.log, checkpoint, once, adopt)
