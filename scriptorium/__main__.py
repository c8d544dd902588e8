"""Command line: ``spark-submit scriptorium/__main__.py train|evaluate|score|audit|pack|stream ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from scriptorium.plans.jobs import run_audit, run_evaluation, run_packing, run_scoring, run_stream, run_training, write_reports
from scriptorium.schema import DEFAULTS
from scriptorium.session import build_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="scriptorium")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("audit", "train", "evaluate", "score", "pack", "stream"):
        job = jobs.add_parser(name)
        job.add_argument("--corpus", required=True, help="folder of .txt files, or a packed .parquet corpus")
        if name in ("audit", "train", "evaluate"):
            job.add_argument("--metadata", required=True, nargs="+", help="CSV or parquet sources, in priority order")
            job.add_argument("--output", help="folder for the full reports; only their first rows are printed")
        if name not in ("audit", "pack"):
            job.add_argument("--model", required=True)
        if name in ("train", "evaluate"):
            job.add_argument("--manifest", required=True)
        if name == "train":
            job.add_argument("--unweighted", action="store_true")
            job.add_argument("--exact-split", action="store_true")
            job.add_argument("--allow-small", action="store_true")
            job.add_argument("--text-partitions", type=int, help="tasks for text work; default: the corpus's own splits")
        if name in ("score", "pack", "stream"):
            job.add_argument("--output", required=True)
        if name == "stream":
            job.add_argument("--checkpoint", required=True)
        if name == "pack":
            job.add_argument("--files", type=int, help="number of packed files, about equal in documents")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    if args.job == "audit":
        reports = run_audit(spark, args.metadata, args.corpus)
    elif args.job == "train":
        result, reports = run_training(
            spark, args.metadata, args.corpus, args.model, args.manifest,
            replace(DEFAULTS, text_partitions=args.text_partitions), use_weights=not args.unweighted, exact_split=args.exact_split, allow_small=args.allow_small,
        )
        print(f"best model: {result.best}")
    elif args.job == "evaluate":
        reports = run_evaluation(spark, args.metadata, args.corpus, args.model, args.manifest)
    elif args.job == "pack":
        reports = {"packed": run_packing(spark, args.corpus, args.output, args.files)}
    elif args.job == "stream":
        reports = {"scored": run_stream(spark, args.corpus, args.model, args.output, args.checkpoint)}
    else:
        reports = {"scored": run_scoring(spark, args.corpus, args.model, args.output)}
    if args.job in ("audit", "train", "evaluate") and args.output:
        write_reports(reports, args.output)
    for name, report in reports.items():
        print(name)
        report.show(20, truncate=False)


if __name__ == "__main__":
    main()
