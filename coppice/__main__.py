"""Command line: fit, predict, eval, bench, dump, importance, info, params."""

from __future__ import annotations

import argparse
import itertools
import sys
import time

from .config import GROWERS, OBJECTIVES, SAMPLERS, Config, default_config_toml, dump_config, load_config


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="coppice")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, help: str, *, config: bool = True, model: bool = False, data: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        if config:
            p.add_argument("-c", "--config", help="a TOML file")
            p.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
        if model:
            p.add_argument("--model", required=True)
        if data:
            p.add_argument("--data")
        return p

    p = add("fit", "train and save a model")
    p.add_argument("--model")
    p.add_argument("--init-model")
    p.add_argument("--dump-config", action="store_true")
    p = add("predict", "predictions as CSV", model=True, data=True)
    p.add_argument("--out")
    p.add_argument("--raw-scores", action="store_true")
    p.add_argument("--num-iteration", type=int, default=0)
    add("eval", "metrics of a model", model=True, data=True)
    add("bench", "time fit and predict").add_argument("--model")
    add("dump", "trees as text", config=False, model=True)
    add("importance", "features by gain", config=False, model=True)
    add("info", "objectives, growers and samplers", config=False)
    add("params", "the default configuration", config=False)
    return top


def _config(args) -> Config:
    text = ""
    if args.config:
        with open(args.config) as f:
            text = f.read()
    return load_config(text, args.set).check()


def _features(df) -> list[str]:
    return [c for c in df.columns if c not in ("label", "weight")]


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    args = _parser().parse_args(argv)
    if args.command == "params":
        print(default_config_toml(), file=out)
        return 0
    if args.command == "info":
        for combo in itertools.product(OBJECTIVES, GROWERS, SAMPLERS):
            print(" ".join(combo), file=out)
        return 0
    from .plans.model import Model

    if args.command == "dump":
        print(Model.load(args.model).dump(), end="", file=out)
        return 0
    if args.command == "importance":
        m = Model.load(args.model)
        rows = sorted(zip(m.features, m.importance("gain"), m.importance("split")), key=lambda r: -r[1])
        for name, gain, count in rows:
            print(f"{name}\t{gain:.6g}\t{int(count)}", file=out)
        return 0
    cfg = _config(args)
    if args.command == "fit" and args.dump_config:
        print(dump_config(cfg), file=out)
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions import metrics as M
    from .plans.booster import train
    from .sources.text import read_input, write_predictions

    spark = SparkSession.builder.getOrCreate()
    if args.command in ("fit", "bench"):
        began = time.time()
        df = read_input(spark, cfg.data.train, cfg.data)
        valid = read_input(spark, cfg.data.valid[0], cfg.data) if cfg.data.valid else None
        start = Model.load(args.init_model) if getattr(args, "init_model", None) else None
        model = train(cfg, df, _features(df), "label", "weight" if "weight" in df.columns else None, eval_set=valid, init_model=start)
        fitted = time.time()
        if args.model:
            model.save(args.model)
        if args.command == "bench":
            model.raw(df).write.format("noop").mode("overwrite").save()
            print(f"fit {fitted - began:.3f} s, predict {time.time() - fitted:.3f} s", file=out)
        else:
            names = cfg.metrics.names or [model.objective.default_metric]
            _report(model, df, names, M, F, out)
        return 0
    model = Model.load(args.model)
    df = read_input(spark, args.data, cfg.data)
    if args.command == "eval":
        _report(model, df, cfg.metrics.names or [model.objective.default_metric], M, F, out)
        return 0
    got = model.raw(df, "prediction", args.num_iteration) if args.raw_scores else model.predict(df, num_iteration=args.num_iteration)
    if args.out:
        write_predictions(got, args.out)
    else:
        for r in got.select("prediction").toLocalIterator():
            print(r[0], file=out)
    return 0


def _report(model, df, names, M, F, out) -> None:
    from .plans.model import fresh

    p = fresh(df, "prediction")
    for name in names:
        M.resolve(name, model.objective.task)
        raw = name in ("logloss", "auc") or model.objective.task == "regression"
        scored = model.raw(df, p) if raw and model.n_classes == 1 else model.predict(df, p)
        if model.objective.name == "poisson":
            scored = scored.withColumn(p, F.exp(p))
        print(f"{name}\t{M.evaluate(scored, name, p, 'label').first()['value']:.6f}", file=out)


if __name__ == "__main__":
    sys.exit(main())
