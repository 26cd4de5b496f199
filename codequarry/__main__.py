"""Command line: the three stages as Spark jobs.

    python -m codequarry build    --corpus PARQUET --out DIR [--n 1000] [--seed 11797]
                                  [--completer hash] [--rewriter echo_code]
    python -m codequarry answer   --records DIR --out ROOT --model NAME
                                  --prompt-mode with_code|question_only [--completer hash] [--n-samples 5]
    python -m codequarry evaluate --answers ROOT --model NAME --prompt-mode MODE
                                  --vectors PARQUET --out DIR [--baseline B] [--samples first|best|mean]

A completer is a built-in stub name (``hash``, ``echo_code``) or
``package.module:factory`` returning a completer.  The corpus needs
``code_id`` and ``code`` columns.  Submit with spark-submit on a cluster; the
session's ``spark.checkpoint.dir`` must name a shared folder there.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .functions.prompts import ANSWER_MODES
from .operators import evaluate as E
from .operators import infer as I
from .plans import catalog, jobs
from .session import build_session


def load_factory(spec: str) -> I.CompleterFactory:
    if spec in I.COMPLETERS:
        return I.COMPLETERS[spec]
    module, _, attr = spec.partition(":")
    if not attr:
        raise SystemExit(f"completer must be a stub name or module:factory, got {spec!r}")
    return getattr(importlib.import_module(module), attr)


def main(argv: list[str] | None = None, spark=None) -> int:
    ap = argparse.ArgumentParser(prog="codequarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--corpus", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--n", type=int, default=catalog.DEFAULT_SAMPLE_N)
    b.add_argument("--seed", type=int, default=catalog.DEFAULT_SEED)
    b.add_argument("--completer", default="hash")
    b.add_argument("--rewriter", default="echo_code")
    a = sub.add_parser("answer")
    a.add_argument("--records", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--model", required=True)
    a.add_argument("--prompt-mode", required=True, choices=[m for m in ANSWER_MODES if m != "fewshot"])
    a.add_argument("--completer", default="hash")
    a.add_argument("--n-samples", type=int, default=catalog.DEFAULT_N_SAMPLES)
    e = sub.add_parser("evaluate")
    e.add_argument("--answers", required=True)
    e.add_argument("--model", required=True)
    e.add_argument("--prompt-mode", required=True)
    e.add_argument("--vectors", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--baseline", type=float, default=None)
    e.add_argument("--samples", default="first", choices=["first", "best", "mean"])
    args = ap.parse_args(argv)

    spark = spark or build_session()
    if args.cmd == "build":
        corpus = spark.read.parquet(args.corpus)
        out = jobs.build_qa_dataset(spark, corpus, load_factory(args.completer), load_factory(args.rewriter),
                                    args.out, n=args.n, seed=args.seed)
        print(json.dumps({"records": out.count(), "out": args.out}))
    elif args.cmd == "answer":
        records = spark.read.parquet(args.records)
        out = jobs.answer_records(spark, records, load_factory(args.completer), args.model, args.prompt_mode,
                                  args.out, I.GenerationConfig(n=args.n_samples))
        print(json.dumps({"answered": out.count()}))
    else:
        answers = spark.read.parquet(f"{args.answers.rstrip('/')}/prompt_mode={args.prompt_mode}/model={args.model}")
        vectors = spark.read.parquet(args.vectors)
        _, report = jobs.score_answers(spark, answers, vectors, args.out, args.baseline, args.samples)
        print(E.nested_report_json(E.nested_report(report)).first()["report"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
