"""Jobs for ``spark-submit``: one set of landed frames, or a folder as frames land.

    python -m ticktape batch  --frames IN --root OUT [--config FILTERS] [--topics XT.BTC-USD XA.*]
    python -m ticktape trades --frames IN --root OUT --checkpoint DIR
    python -m ticktape alerts --frames IN --root OUT --checkpoint DIR
    python -m ticktape stage  --frames IN --root OUT --checkpoint DIR [--families quote book bar]

Frames are text files, a frame to a line; ``--table`` reads a Parquet table of ``ingest_seq, frame`` instead.
Every job keeps what it cannot read in ``OUT/rejects``.  Streams stop when nothing is left to read unless ``--every`` names an interval.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ticktape import schemas as S
from ticktape.operators import filters, price_action, topics
from ticktape.plans import market
from ticktape.sinks import publish
from ticktape.sources import filter_config, frames
from ticktape.streaming import trades


def _arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ticktape")
    parser.add_argument("job", choices=["batch", "trades", "alerts", "stage"])
    parser.add_argument("--frames", required=True)
    parser.add_argument("--table", action="store_true", help="--frames is a table of ingest_seq and frame")
    parser.add_argument("--kafka", metavar="SERVERS", help="--frames names a topic there (needs the connector)")
    parser.add_argument("--alerts-topic", help="alerts go to this topic as well (alerts job with --kafka)")
    parser.add_argument("--root", required=True)
    parser.add_argument("--checkpoint")
    parser.add_argument("--config", help="saved filter configuration; the built-in one if left out")
    parser.add_argument("--topics", nargs="*", default=list(topics.DEFAULT_TOPICS), help="none named: all topics")
    parser.add_argument("--threshold", type=float, default=price_action.DEFAULT_THRESHOLD, help="percent")
    parser.add_argument("--scope", choices=["pair", "bar"], default="pair")
    parser.add_argument("--conditions", choices=["keep", "as_run"], default="keep")
    parser.add_argument("--families", nargs="*", choices=["quote", "book", "bar"], help="stored whole; all three in stage, none in batch")
    parser.add_argument("--max-files", type=int, default=100, help="files per micro-batch")
    parser.add_argument("--every", help="trigger interval, such as '10 seconds'")
    args = parser.parse_args(argv)
    if args.job != "batch" and not args.checkpoint:
        parser.error(f"{args.job} needs --checkpoint")
    if args.alerts_topic and (args.job != "alerts" or not args.kafka):
        parser.error("--alerts-topic goes with the alerts job and --kafka")
    return args


def _event_filters(spark: SparkSession, path: str | None) -> dict[str, filters.EventFilter]:
    if path is None:
        return {"default": filters.parameterized()}
    return {"default": filters.configured(filter_config.load_filter_config(spark, path))}


def _run(writer: DataStreamWriter, every: str | None) -> None:
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def main(argv=None) -> None:
    args = _arguments(argv)
    spark = SparkSession.builder.appName(f"ticktape-{args.job}").getOrCreate()
    wanted = args.topics or None
    families = [S.FAMILIES[name] for name in args.families or ()]
    if args.job == "batch":
        read = frames.read_frame_table if args.table else frames.read_text_frames
        chosen = _event_filters(spark, args.config)
        landed = frames.kafka_frames(spark, args.kafka, args.frames, stream=False) if args.kafka else read(spark, args.frames)
        market.run_batch(landed, args.root, chosen, wanted, args.threshold, args.scope, args.conditions, families)
        return
    if args.kafka:
        landed = frames.kafka_frames(spark, args.kafka, args.frames)
    else:
        read = frames.stream_frame_table if args.table else frames.stream_text_frames
        landed = read(spark, args.frames, max_files=args.max_files)
    if args.job == "trades":
        chosen = _event_filters(spark, args.config)
        writer = trades.persist_matches(landed, args.root, args.checkpoint, chosen, wanted, args.conditions)
    elif args.job == "alerts":
        also = (lambda found: publish.publish_alerts(found, args.kafka, args.alerts_topic)) if args.alerts_topic else None
        writer = trades.persist_alerts(landed, args.root, args.checkpoint, args.threshold, args.scope, wanted, also)
    else:
        families = families or [S.QUOTE, S.BOOK, S.BAR]
        writer = trades.persist_families(landed, args.root, args.checkpoint, families, wanted)
    _run(writer, args.every)


if __name__ == "__main__":
    main()
