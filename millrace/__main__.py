"""Command line: ``python -m millrace stage|ingest|precompute|train|merge ...``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from millrace.plans import config


def _options(parser: argparse.ArgumentParser, kind: type) -> None:
    """An option per field: ``--block-size`` for ``block_size``."""
    for f in dataclasses.fields(kind):
        name, needed = f"--{f.name.replace('_', '-')}", f.default is dataclasses.MISSING
        if f.type == "bool":
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        elif "dict" in f.type:
            parser.add_argument(name, default=None, help="JSON file")
        elif "tuple" in f.type:
            parser.add_argument(name, nargs="*", default=())
        else:
            parse = float if f.type.startswith("float") else int if f.type.startswith("int") else str
            parser.add_argument(name, type=parse, required=needed, default=None if needed else f.default)


def _made(spark, kind: type, args: argparse.Namespace):
    from millrace.sources.corpus import read_map

    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(kind)}
    return kind(**{f.name: read_map(spark, values[f.name]) if "dict" in f.type else tuple(values[f.name]) if "tuple" in f.type else values[f.name] for f in dataclasses.fields(kind)})


#: What a reference pass must be told, by options, environment or settings.
PRECOMPUTE = ("blocks", "domain", "cache")


def _variable(name: str) -> str:
    return f"MILLRACE_PRECOMPUTE_{name.upper()}"


def _layers(args: argparse.Namespace) -> dict:
    """Settings of the files, defaults first (MILLRACE_DEFAULTS), and overrides."""
    defaults = [os.environ["MILLRACE_DEFAULTS"]] if os.environ.get("MILLRACE_DEFAULTS") else []
    return config.merged(*map(config.read_settings, [*defaults, *args.config]), *map(config.override, args.overrides))


def _precompute_settings(args: argparse.Namespace) -> dict[str, str]:
    mixer = _layers(args).get("mixer", {})
    given = {"blocks": mixer.get("corpus_path"), "domain": mixer.get("adapt_domain"), "cache": mixer.get("ref_loss_cache_path")}
    found = {n: getattr(args, n) or os.environ.get(_variable(n)) or given[n] for n in PRECOMPUTE}
    lost = [f"--{n} or {_variable(n)}" for n, v in found.items() if not v]
    if lost:
        raise SystemExit(f"precompute needs {'; '.join(lost)}")
    return found


def _model_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--model", help="ONNX file of a causal language model to score with; without it a count model is trained")
    p.add_argument("--order", type=int, default=3, help="tokens that the count model looks at, the scored one included")
    p.add_argument("--vocabulary", type=int, default=1 << 17, help="ids that an unseen token may be one of")


def _scorer(spark, args: argparse.Namespace, blocks=None):
    from millrace.operators.ngram import NgramScorer
    from millrace.operators.scoring import OnnxScorer

    return OnnxScorer(args.model) if args.model else NgramScorer(spark, args.order, space=args.vocabulary, blocks=blocks)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("stage", help="copy evenly spread files of each origin")
    p.add_argument("--spec", required=True, help="JSON list of origin, repo, prefix, capability, n_shards")
    p.add_argument("--out", required=True)
    p.add_argument("--capability-map-out")
    p.add_argument("--shards-scale", type=float, default=1.0)
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("ingest", help="raw text to a blocks table")
    _options(p, config.IngestConfig)
    p.add_argument("--log", help="folder of earlier ingestions: only files that are new are read")
    p = sub.add_parser("precompute", help="reference losses of one domain, by the count model")
    for name in PRECOMPUTE:
        p.add_argument(f"--{name}", help=f"or {_variable(name)} in the environment")
    p.add_argument("--config", nargs="+", default=[], help="JSON or YAML files whose mixer settings name the blocks and the cache")
    _model_options(p)
    p.add_argument("--max-rows", type=int, default=-1)
    p.add_argument("--buckets", type=int, help="buckets of the cache; like those of the blocks, the join needs no shuffle")
    p.add_argument("--set", dest="overrides", nargs="+", default=[], metavar="NAME=VALUE", help="settings over the files")
    p = sub.add_parser("train", help="score, select, learn and log; goes on from the last checkpoint in --out")
    p.add_argument("--config", nargs="+", required=True, help="JSON or YAML files; later ones override")
    p.add_argument("--set", dest="overrides", nargs="+", default=[], metavar="NAME=VALUE", help="settings over the files, like train.top_k=64")
    p.add_argument("--strict", action="store_true")
    _model_options(p)
    p.add_argument("--out", required=True)
    p = sub.add_parser("merge", help="weighted merge of two models")
    for name in ("base", "specialist", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--weight", type=float, default=0.5)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from millrace.sources import corpus

    if args.command == "stage":
        from millrace.sources.staging import stage

        with open(args.spec, encoding="utf-8") as f:
            spec = json.load(f)
        stage(spark, spec, args.out, args.shards_scale, args.dry_run).orderBy("origin").show(1000, False)
        if args.capability_map_out:
            corpus.write_map(spark, {s["origin"]: s.get("capability", s["origin"]) for s in spec}, args.capability_map_out)
    elif args.command == "ingest":
        from millrace.plans.ingest import build_corpus, ingest_more, publish

        cfg = _made(spark, config.IngestConfig, args)
        if args.log:
            ingest_more(spark, cfg, args.log)
        counts = publish(spark, cfg, args.log) if args.log else build_corpus(spark, cfg)
        counts.orderBy("domain", "origin").show(1000, False)
    elif args.command == "precompute":
        from millrace.plans.precompute import precompute

        told = _precompute_settings(args)
        blocks = corpus.read_blocks(spark, told["blocks"])
        precompute(blocks, told["domain"], _scorer(spark, args, blocks.where(blocks.domain == told["domain"])), told["cache"], args.max_rows, args.buckets)
    elif args.command == "train":
        from millrace.plans.train import prepare, resume, train_loop

        run = config.build(config.RunConfig, _layers(args), args.strict)
        rows, val = prepare(spark, run.mixer)
        scorer = _scorer(spark, args)
        print(train_loop(rows, val, scorer, run.train, resume(spark, args.out, scorer), args.out))
    else:
        from millrace.operators.merge import merge_weights
        from millrace.sources.tensors import copy_others, read_tensors, write_tensors

        merged = merge_weights(read_tensors(spark, args.base), read_tensors(spark, args.specialist), args.weight).persist()
        print(f"merged {merged.where('merged').count()}, kept {merged.where('not merged').count()}")
        write_tensors(merged, args.out)
        copy_others(spark, args.base, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
