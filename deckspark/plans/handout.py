"""Handing out work and taking it back: sweeps, decks, completions and the turn of the cycle.

Everything is a batch of the work log, written under the name of its request: a request that is repeated after a
crash gets what it got. Tables are never stamped; leases and swept units follow from the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.functions.formats import BATCH_SIZE
from deckspark.operators.worklist import (
    apply_work,
    cycle_is_over,
    deck_worklist,
    next_sweeps,
    sweep_units,
    without_leased,
)
from deckspark.operators.skew import lookup_join
from deckspark.plans.corpus import Corpus


class Handout:
    """Work on the units of ``status`` and the decks of ``corpus``, through its work log."""

    def __init__(self, status: DataFrame, cards: DataFrame, corpus: Corpus):
        self.status, self.cards, self.corpus, self.log = status, cards, corpus, corpus.work_log

    def units(self) -> DataFrame:
        """The sweep units as they stand."""
        return apply_work(self.status, self.log.read())

    def sweeps(self, as_of: Column, k: int, worker: str, request: str) -> DataFrame:
        """Lease the next k sweeps: (card_id, card_name, search_name, format, mode).

        Where no unit is left to lease and no deck is waiting, the next cycle starts first. The turn is a batch
        of its own: if the job breaks off behind it, the repeated request goes on from there.
        """
        if self.log.of_request(request).isEmpty():
            if cycle_is_over(self.units(), self.corpus.decks.read(), as_of):
                one = self.log.spark.range(1).select()
                self.log.append(one, "reset", worker, as_of, f"{request}/reset")
            chosen = next_sweeps(self.units(), as_of, k)
            self.log.append(chosen, "claim", worker, as_of, request)
        mine = self.log.of_request(request).select("card_id", "format", "batch")
        before = apply_work(self.status, self.log.read(stop=mine.agg(F.max("batch")).first()[0] or 0))
        return sweep_units(before.join(F.broadcast(mine.drop("batch")), ["card_id", "format"], "left_semi"), self.cards)

    def decks(self, as_of: Column, worker: str, request: str, n: int = BATCH_SIZE) -> DataFrame:
        """Lease up to n decks of the first format that has any: (format, moxfield_id)."""
        # Ends are taken as a build takes them, so a build that knows the claim knows what it saw.
        ends = (self.corpus.stub_log.end(), self.corpus.submission_log.end())
        since = self.log.read(self.corpus.reached()[2])
        waiting = deck_worklist(without_leased(self.corpus.decks.read(), since, as_of), as_of, n)
        return self.log.append(waiting, "claim", worker, as_of, request, ends).select("format", "moxfield_id")

    def complete(self, finished: DataFrame, worker: str, as_of: Column, request: str) -> DataFrame:
        """Log finished sweeps (card_name, format); returns those that name no unit."""
        ids = self.cards.select("card_name", F.col("id").alias("card_id"))
        found = lookup_join(finished.select("card_name", "format").distinct(), ids, ["card_name"])
        units = self.status.select("card_id", "format")
        self.log.append(found.join(units, ["card_id", "format"], "left_semi"), "complete", worker, as_of, request)
        return found.join(units, ["card_id", "format"], "left_anti").select("card_name", "format")
