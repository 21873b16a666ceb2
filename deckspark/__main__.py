"""Command line: ``python -m deckspark <job> --root <shared folder> ...``."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import functions as F

from deckspark.functions.formats import BATCH_SIZE
from deckspark.operators.quality import check_corpus, require_cards
from deckspark.operators.worklist import deck_worklist, next_cycle, sweep_worklist, without_leased
from deckspark.plans.corpus import BUILDS, Corpus
from deckspark.plans.handout import Handout
from deckspark.plans.seed import seed_cards, seed_from_manifest, table_stats
from deckspark.schemas import (
    ATTEMPT_STATE,
    CARD_FORMAT_STATUS,
    CARDS,
    DECK_CARDS,
    DECKS,
    OPEN_DECKS,
    STATUS_DEFAULTS,
    STUB_LOG,
    SUBMISSION_LOG,
    SWEEP_STATE,
    WORK_LOG,
)
from deckspark.session import build_session
from deckspark.sources.cards import BULK_TYPES, land_export
from deckspark.sources.landings import read_details, read_pages
from deckspark.sources.keyed import KeyedTable
from deckspark.sources.snapshots import SnapshotTable
from deckspark.streaming.discovery import StubSink, start_discovery
from deckspark.streaming.logs import BatchLog, WorkLog
from deckspark.streaming.submissions import SubmissionSink, start_submissions


class Tables:
    """All tables below one folder."""

    def __init__(self, spark, root: str, buckets: int):
        self.spark, self.root = spark, root
        key = ("format", "moxfield_id")
        self.cards = SnapshotTable(spark, f"{root}/cards", CARDS)
        self.status = SnapshotTable(spark, f"{root}/card_format_status", CARD_FORMAT_STATUS, defaults=STATUS_DEFAULTS)
        self.found = KeyedTable(spark, f"{root}/found_decks", DECKS, key, buckets)
        self.attempts = KeyedTable(spark, f"{root}/attempts", ATTEMPT_STATE, key, buckets)
        self.sweeps = KeyedTable(spark, f"{root}/sweeps", SWEEP_STATE, ("sweep_card", "sweep_format"), buckets)
        self.corpus = Corpus(
            BatchLog(spark, f"{root}/stub_log", STUB_LOG),
            BatchLog(spark, f"{root}/submission_log", SUBMISSION_LOG),
            KeyedTable(spark, f"{root}/decks", DECKS, key, buckets),
            KeyedTable(spark, f"{root}/deck_cards", DECK_CARDS, key, buckets),
            SnapshotTable(spark, f"{root}/builds", BUILDS),
            WorkLog(spark, f"{root}/work_log", WORK_LOG),
            KeyedTable(spark, f"{root}/open_decks", OPEN_DECKS, key, buckets),
        )

    def handout(self) -> Handout:
        return Handout(self.status.read(), self.cards.read(), self.corpus)


def next_version(table: SnapshotTable) -> int:
    return (table.latest() or 0) + 1


def seed(tables: Tables, args: argparse.Namespace) -> None:
    version = next_version(tables.cards)
    landed = f"{tables.root}/landed/{version}"
    if args.manifest:
        done = seed_from_manifest(
            tables.spark, args.manifest, landed, tables.cards, tables.status, version, args.bulk,
            args.refresh_all, args.lines,
        )
    else:
        raw = land_export(tables.spark, args.export, landed, args.lines)
        done = seed_cards(raw, tables.cards, tables.status, version, args.refresh_all)
    print(f"{done.inserted} inserted, {done.updated} updated, {done.collisions} repeated names dropped")
    info(tables, args)


def info(tables: Tables, args: argparse.Namespace) -> None:
    total, per_format = table_stats(tables.cards.read(), tables.status.read())
    total.show()
    per_format.show(truncate=False)


def discover(tables: Tables, args: argparse.Namespace) -> None:
    def finished(sweeps, batch_id):
        tables.handout().complete(sweeps, "discover", F.current_timestamp(), f"discover/{batch_id}")

    sink = StubSink(
        tables.found, tables.corpus.stub_log, f"{tables.root}/broken_pages", args.merge_every, tables.sweeps, finished
    )
    pages = read_pages(tables.spark, args.landing, stream=True, files_per_batch=args.files_per_batch)
    query = start_discovery(pages, sink, f"{tables.root}/checkpoints/discover", not args.keep_running, args.adopt)
    try:
        query.awaitTermination()
    finally:
        # What still waits is merged however the run ends.
        query.stop()
        sink.finish()


def submit(tables: Tables, args: argparse.Namespace) -> None:
    require_cards(tables.cards.read())
    sink = SubmissionSink(
        tables.cards, tables.corpus, f"{tables.root}/outcomes", f"{tables.root}/unknown_cards",
        f"{tables.root}/broken_documents", tables.attempts if args.attempts else None, f"{tables.root}/unknown_cards_text",
    )
    details = read_details(tables.spark, args.landing, stream=True, files_per_batch=args.files_per_batch)
    start_submissions(
        details, sink, f"{tables.root}/checkpoints/submit", not args.keep_running, args.adopt
    ).awaitTermination()


def build(tables: Tables, args: argparse.Namespace) -> None:
    print(f"version {tables.corpus.build()}")


def resolve(tables: Tables, args: argparse.Namespace) -> None:
    print(f"{tables.corpus.resolve_again(tables.cards.read())} decks changed")


def sweeps(tables: Tables, args: argparse.Namespace) -> None:
    now, work = F.current_timestamp(), tables.handout()
    if args.worker:
        rows = work.sweeps(now, args.limit, args.worker, args.request or f"{args.worker}/{uuid.uuid4().hex}")
    else:
        status = next_cycle(work.units(), tables.corpus.decks.read(), now)
        rows = sweep_worklist(status, tables.cards.read(), now, args.limit)
    rows.show(args.limit, truncate=False)


def decks(tables: Tables, args: argparse.Namespace) -> None:
    now, work = F.current_timestamp(), tables.handout()
    if args.worker:
        rows = work.decks(now, args.worker, args.request or f"{args.worker}/{uuid.uuid4().hex}", args.limit)
    else:
        rows = deck_worklist(without_leased(tables.corpus.decks.read(), work.log.read(tables.corpus.reached()[2]), now), now, args.limit)
    rows.select("format", "moxfield_id").show(args.limit, truncate=False)


def complete(tables: Tables, args: argparse.Namespace) -> None:
    done = tables.spark.createDataFrame([(args.card, args.format)], "card_name string, format string")
    lost = tables.handout().complete(done, args.worker, F.current_timestamp(), args.request or uuid.uuid4().hex)
    if not lost.isEmpty():
        raise SystemExit(f"no unit for card {args.card!r} in format {args.format!r}")


def vacuum(tables: Tables, args: argparse.Namespace) -> None:
    corpus, changes = tables.corpus, SnapshotTable(tables.spark, f"{tables.cards.path}_changes", CARDS)
    built = (corpus.decks, corpus.deck_cards, corpus.open_decks)
    # Notes of builds go with their tables: what is judged before them is worked out from the logs instead.
    for table in (tables.found, tables.sweeps, tables.attempts, tables.cards, changes, tables.status, corpus.builds, *built):
        print(f"{table.path}: {len(table.vacuum(args.keep))} folders removed")


def check(tables: Tables, args: argparse.Namespace) -> None:
    checked = (tables.cards, tables.status, tables.corpus.decks, tables.corpus.deck_cards)
    check_corpus(*[t.read() for t in checked]).show(100, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="deckspark", description=__doc__)
    top.add_argument("--root", required=True, help="shared folder of the tables")
    top.add_argument("--master", help="only for local runs")
    top.add_argument("--buckets", type=int, default=512, help="buckets of the table of found decks")
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("seed", help="merge a card export into the card table")
    source = job.add_mutually_exclusive_group(required=True)
    source.add_argument("--manifest", help="list of exports")
    source.add_argument("--export", help="one export")
    job.add_argument("--bulk", choices=BULK_TYPES, default="oracle_cards")
    job.add_argument("--lines", action="store_true", help="the export has one card per line")
    job.add_argument("--refresh-all", action="store_true", help="also add newly legal formats of known cards")
    job.set_defaults(run=seed)

    jobs.add_parser("info", help="table statistics").set_defaults(run=info)
    for name, run in (("discover", discover), ("submit", submit)):
        job = jobs.add_parser(name, help=f"{name} what has landed")
        job.add_argument("--landing", required=True)
        job.add_argument("--files-per-batch", type=int, default=1000)
        job.add_argument("--keep-running", action="store_true")
        job.add_argument("--adopt", action="store_true", help="the checkpoint is lost or new: go on after the log's last batch")
        if run is discover:
            job.add_argument("--merge-every", type=int, default=1, help="micro-batches per merge")
        else:
            job.add_argument("--attempts", action="store_true", help="errors are single attempts; three in a row make one")
        job.set_defaults(run=run)
    jobs.add_parser("build", help="build the deck tables from the logs").set_defaults(run=build)
    jobs.add_parser("resolve", help="after seeding: look up unresolved names of built decks again").set_defaults(run=resolve)
    for name, run, limit in (("sweeps", sweeps, 1), ("decks", decks, BATCH_SIZE)):
        job = jobs.add_parser(name, help=f"next {name} to work on")
        job.add_argument("--limit", type=int, default=limit)
        job.add_argument("--worker", help="lease them to this worker")
        job.add_argument("--request", help="name of the request; repeated, it gets the same")
        job.set_defaults(run=run)
    job = jobs.add_parser("complete", help="a sweep is finished")
    job.add_argument("--card", required=True)
    job.add_argument("--format", required=True)
    job.add_argument("--worker", default="hand")
    job.add_argument("--request")
    job.set_defaults(run=complete)
    job = jobs.add_parser("vacuum", help="remove what the last versions do not need")
    job.add_argument("--keep", type=int, default=2, help="versions to keep")
    job.set_defaults(run=vacuum)
    jobs.add_parser("check", help="constraint report").set_defaults(run=check)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(Tables(build_session(args.master), args.root, args.buckets), args)


if __name__ == "__main__":
    main()
