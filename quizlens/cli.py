"""Command line: demo, pathology, convert, compare, audit. Runs under spark-submit or on one machine."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

import quizlens
from quizlens.judgement import Audit, Rule
from quizlens.operators.backends import HostedChat, causal
from quizlens.operators.detectors import run_detectors
from quizlens.operators.sampling import prepared
from quizlens.operators.scoring import ApiScorer, LocalScorer, SimulatedScorer, default_threads
from quizlens.plans.audit import run_audit
from quizlens.plans.report import compare, from_json, render, render_comparison, render_corpus, to_json
from quizlens.session import local_session, stages
from quizlens.sources.benchmarks import LOADERS, write_canonical
from quizlens.sources.synthetic import generate

DEMO_ITEMS = 500


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or local_session()


def _rule(args: argparse.Namespace) -> Rule:
    return Rule(args.alpha, args.power, args.bootstrap, args.min_effect)


def _show(audit: Audit, path: str | None) -> None:
    print(render(audit))
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(to_json(audit) + "\n", encoding="utf-8")


def _corpus(args: argparse.Namespace):
    return prepared(LOADERS[args.format](_spark(), args.corpus), Path(args.corpus).stem, args.items, args.seed)


def cmd_demo(args: argparse.Namespace) -> None:
    skewed = {"position": 0.5, "favoured": 1} if args.position > 0 else {}
    items = generate(_spark(), DEMO_ITEMS, args.seed, **skewed)
    rates = {"skill": args.skill, "memory": args.memorisation, "distractors": args.distractor, "options": args.choices_only}
    scorer = SimulatedScorer(rates, args.position, skewed.get("favoured", 0), args.seed)
    _show(run_audit(items, "demo", scorer, args.audit_seed, _rule(args)), args.json)


def cmd_pathology(args: argparse.Namespace) -> None:
    items, _ = _corpus(args)
    print(render_corpus(run_detectors(items, args.seed, _rule(args))))


def cmd_convert(args: argparse.Namespace) -> None:
    write_canonical(LOADERS[args.format](_spark(), args.corpus), args.output)


def cmd_compare(args: argparse.Namespace) -> None:
    runs = [from_json(Path(p).read_text(encoding="utf-8")) for p in (args.baseline, args.variant)]
    print(render_comparison(compare(_spark(), *runs)))


def _loaded(spec: str):
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError("an adapter is given as module:function")
    return getattr(importlib.import_module(module), name)


def _scorer(args: argparse.Namespace):
    if args.backend == "api":
        if not args.adapter and not args.url:
            raise ValueError("a hosted model needs --url, or an --adapter")
        key = os.environ.get(args.key_variable) if args.key_variable else None
        return ApiScorer(args.model, _loaded(args.adapter) if args.adapter else HostedChat(args.url, args.model, key))
    threads = args.threads or default_threads()
    load = _loaded(args.adapter) if args.adapter else causal(args.model, args.dtype, threads)
    return LocalScorer(args.model, load, args.style, not args.unnormalised, args.dtype, threads)


def cmd_audit(args: argparse.Namespace) -> None:
    items, name = _corpus(args)
    _show(run_audit(items, name, _scorer(args), args.seed, _rule(args)), args.json)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quizlens", description="Audits multiple-choice corpora and the scores reported on them.")
    top.add_argument("--version", action="version", version=f"quizlens {quizlens.__version__}")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, text: str, gate: bool = False) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=text)
        p.set_defaults(run=run)
        if gate:
            p.add_argument("--alpha", type=float, default=0.01)
            p.add_argument("--power", type=float, default=0.8)
            p.add_argument("--bootstrap", type=int, default=10_000)
            p.add_argument("--min-effect", type=float, default=0.005)
        return p

    p = verb("demo", cmd_demo, "audit a simulated model on a synthetic corpus", gate=True)
    for option, default in (("skill", 0.4), ("memorisation", 0.25), ("distractor", 0.2), ("position", 0.0), ("choices-only", 0.0)):
        p.add_argument(f"--{option}", type=float, default=default)
    p.add_argument("--seed", type=int, default=11)
    p.add_argument("--audit-seed", type=int, default=7)
    p.add_argument("--json")

    def corpus(p: argparse.ArgumentParser, default: str) -> None:
        p.add_argument("corpus")
        p.add_argument("--format", choices=sorted(LOADERS), default=default)

    p = verb("pathology", cmd_pathology, "measure the defects of a corpus", gate=True)
    corpus(p, "canonical")
    p.add_argument("--items", type=int)
    p.add_argument("--seed", type=int, default=7)

    p = verb("convert", cmd_convert, "write a corpus as canonical JSON Lines")
    corpus(p, "arc")
    p.add_argument("output")

    p = verb("compare", cmd_compare, "compare two report files")
    p.add_argument("baseline")
    p.add_argument("variant")

    p = verb("audit", cmd_audit, "audit a model on a corpus", gate=True)
    corpus(p, "canonical")
    p.add_argument("model")
    p.add_argument("--adapter", help="module:function that loads the model, or calls the service, instead of the built-in ones")
    p.add_argument("--url", help="chat-completions address of a hosted model")
    p.add_argument("--key-variable", help="environment variable that holds the key of the hosted model")
    p.add_argument("--backend", choices=("local", "api"), default="local")
    p.add_argument("--items", type=int)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--style", choices=("cloze", "labelled"), default="cloze")
    p.add_argument("--dtype", default="float32")
    p.add_argument("--threads", type=int)
    p.add_argument("--unnormalised", action="store_true")
    p.add_argument("--json")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        with stages():
            args.run(args)
    except (ValueError, FileNotFoundError, ImportError, AnalysisException) as error:  # the last: a path that does not exist
        print(f"quizlens: {str(error).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0
