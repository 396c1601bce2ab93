"""Commands: ask, report, calibrate, soft-rows, build-data, decisions, teacher, mine-negatives, synth-flag, synth-decisions, serve, http. Errors of input become one line and exit status 1 (ask: 2)."""

from __future__ import annotations

import argparse
import json
import sys


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("verdica").getOrCreate()


def ask(args: argparse.Namespace) -> int:
    from .operators.calibrate import Calibrator
    from .operators.schema import Invalid, request
    from .plans.engine import answer

    text = sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()
    try:
        request(json.loads(text))
    except (Invalid, json.JSONDecodeError) as e:
        print(f"invalid request: {e}", file=sys.stderr)
        return 2
    spark = _spark()
    good, _ = answer(spark.createDataFrame([("0", text)], "request_id string, body string"), cal=Calibrator.load(args.calibrator) if args.calibrator else None)
    for row in good.collect():
        print(json.dumps({"model": row["model"], "answers": json.loads(row["answers"]), "usage": {"input_tokens": row["input_tokens"], "output_tokens": 0}}, ensure_ascii=False))
    return 0


def _raw(paths: list[str]):
    from pyspark.sql import functions as F

    from .operators.metrics import union_all
    from .sources.rows import last_wins, read_raw, run_folders

    spark = _spark()
    frames = []
    for folder in run_folders(spark, paths):
        rows = read_raw(spark, f"{folder}/raw.jsonl").withColumn("run_id", F.lit(folder.rstrip("/").rsplit("/", 1)[-1]))
        frames.append(last_wins(rows, ["run_id", "id"], "line").drop("line"))
    if not frames:
        raise ValueError("no run folders found")
    return union_all(frames)


def report(args: argparse.Namespace) -> int:
    from .plans.report import write_report

    for line in write_report(_raw(args.runs), args.out):
        print(f"skipped {line}", file=sys.stderr)
    return 0


def calibrate(args: argparse.Namespace) -> int:
    from .operators.calibrate import pooled_calibrator

    pooled_calibrator(_raw(args.runs)).save(args.out)
    return 0


def soft_rows(args: argparse.Namespace) -> int:
    from .curate.synth import soft_rows as merge
    from .sources.rows import read_decisions

    spark = _spark()
    teacher = spark.read.schema("id string, label int, probs array<double>, agree boolean, per_order array<array<double>>").json(args.teacher)
    merge(read_decisions(spark, args.rows), teacher).write.mode("overwrite").json(args.out)
    return 0


def build_data(args: argparse.Namespace) -> int:
    from .curate import dataset

    if (scale := float(args.scale)) <= 0:
        raise ValueError("scale must be above 0")
    spark = _spark()
    load, splits = dataset.folders(spark, args.root, args.sources)
    dataset.write(dataset.build_data(spark, load, splits, args.seed, scale), args.out)
    return 0


def read_decisions_command(args: argparse.Namespace) -> int:
    """Checks a decisions file and counts its rows."""
    from .sources.decisions import read_decisions_file

    rows = read_decisions_file(_spark(), args.file, args.name)
    print(json.dumps({"name": args.name, "type": rows.select("type").first()[0], "rows": rows.count()}))
    return 0


def teacher(args: argparse.Namespace) -> int:
    """Teacher's scores of a decisions file, in a run that goes on where it died."""
    from pyspark.sql import functions as F

    from .operators.scoring import lexical_backend
    from .plans.teach import teacher_scores
    from .sources.chunks import committed_rows, run_chunks
    from .sources.decisions import read_decisions_file

    rows = read_decisions_file(_spark(), args.file).withColumn("request_id", F.col("id"))
    run_chunks(rows, args.out, lambda part: teacher_scores(part, lexical_backend, args.seed), "request_id", args.seed)
    done = committed_rows(_spark(), args.out)
    print(json.dumps({"rows": done.count(), "agree": done.where("agree").count()}))
    return 0


def mine_negatives(args: argparse.Namespace) -> int:
    from .operators.scoring import lexical_backend
    from .plans.teach import mined_negatives, mining_summary

    spark = _spark()
    found = mined_negatives(spark.read.schema("id string, text string, label string").json(args.rows), spark.read.schema("name string, place int").json(args.labels), lexical_backend, int(args.keep))
    found.write.mode("overwrite").json(args.out)
    print(json.dumps(mining_summary(spark.read.schema(found.schema).json(args.out)).first().asDict()))
    return 0


def synth_flag(args: argparse.Namespace) -> int:
    from .curate.synth import flag_banking
    from .operators.scoring import lexical_backend
    from .plans.teach import teacher_scores

    intents = _spark().read.schema("domain string, intent string, description string").json(args.intents)
    flags = flag_banking(intents, lambda rows: teacher_scores(rows, lexical_backend), args.out)
    print(json.dumps({"intents": flags.count(), "flagged": flags.where("flag").count()}))
    return 0


def synth_decisions(args: argparse.Namespace) -> int:
    from .curate.synth import decisions
    from .operators.scoring import lexical_backend
    from .plans.teach import candidate_margins

    spark = _spark()
    said = spark.read.schema("domain string, intent string, n long, text string").json(args.utterances)
    labels = spark.read.schema("domain string, intent string, place int").json(args.labels)
    rows = decisions(said, labels, lambda pairs: candidate_margins(pairs, lexical_backend, ["domain", "n"]), args.out, args.seed)
    print(json.dumps({"rows": rows.count(), "gold_first": rows.where("gold_rank = 0").count()}))
    return 0


def serve(args: argparse.Namespace) -> int:
    from .streaming.serve import request_stream
    from .streaming.serve import serve as start

    start(request_stream(_spark(), args.folder), f"{args.out}/answers", f"{args.out}/errors", f"{args.out}/checkpoint").awaitTermination()
    return 0


def http(args: argparse.Namespace) -> int:
    from .operators.calibrate import Calibrator
    from .streaming.http import Service, listening

    cal = Calibrator.load(args.calibrator) if args.calibrator else None
    with listening(Service(_spark(), cal=cal, key=args.key), args.host, int(args.port)) as server:
        print(f"ready on http://{server.server_address[0]}:{server.server_address[1]}", flush=True)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            return 0
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verdica", description=__doc__)
    sub = parser.add_subparsers(required=True)
    commands = {
        "ask": (ask, [("file", {"nargs": "?", "default": "-"}), ("--calibrator", {})]),
        "report": (report, [("runs", {"nargs": "+"}), ("--out", {"required": True})]),
        "calibrate": (calibrate, [("runs", {"nargs": "+"}), ("--out", {"required": True})]),
        "soft-rows": (soft_rows, [("--rows", {"required": True}), ("--teacher", {"required": True}), ("--out", {"required": True})]),
        "build-data": (build_data, [("root", {}), ("--out", {"required": True}), ("--seed", {"default": "0"}), ("--scale", {"default": "1"}), ("--sources", {"nargs": "*"})]),
        "decisions": (read_decisions_command, [("file", {}), ("--name", {"default": "decisions"})]),
        "teacher": (teacher, [("file", {}), ("--out", {"required": True}), ("--seed", {"default": "0"})]),
        "mine-negatives": (mine_negatives, [("rows", {}), ("--labels", {"required": True}), ("--out", {"required": True}), ("--keep", {"default": "15"})]),
        "synth-flag": (synth_flag, [("intents", {}), ("--out", {"required": True})]),
        "synth-decisions": (synth_decisions, [("utterances", {}), ("--labels", {"required": True}), ("--out", {"required": True}), ("--seed", {"default": "0"})]),
        "serve": (serve, [("folder", {}), ("--out", {"required": True})]),
        "http": (http, [("--host", {"default": "127.0.0.1"}), ("--port", {"default": "8766"}), ("--key", {}), ("--calibrator", {})]),
    }
    for name, (run, arguments) in commands.items():
        command = sub.add_parser(name)
        for flag, options in arguments:
            command.add_argument(flag, **options)
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
