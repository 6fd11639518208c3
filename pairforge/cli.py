"""Command line: python -m pairforge.cli COMMAND ...; free parameters are given as --name value or --name=value."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from pairforge.session import get_session


def parse_free(args: list[str]) -> dict[str, int | float | bool | str]:
    """``--a 1 --b=2.5 --c true`` as values: integers, numbers, booleans, else text. A value with a second '=' raises ValueError."""

    def value(raw: str):
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(raw.lower(), raw)

    out, name = {}, None
    for arg in args:
        if name is not None:
            out[name], name = value(arg), None
        elif arg.startswith("--") and "=" in arg:
            key, raw = arg[2:].split("=")
            out[key] = value(raw)
        elif arg.startswith("--"):
            name = arg[2:]
        else:
            raise ValueError(f"no parameter: {arg}")
    if name is not None:
        raise ValueError(f"no value for {name}")
    return out


def _matcher(spark: SparkSession, name: str, free: dict, dataset: str | None = None, vectors: str | None = None):
    """A matcher by name; without parameters the tuned one of the data set, if there is one."""
    from pairforge.functions import text as T
    from pairforge.functions.encoders import hashed
    from pairforge.operators import chat as C
    from pairforge.operators import matchers as MA
    from pairforge.operators import presets as PS
    from pairforge.operators import tfidf as TF

    if not free and dataset in PS.KEYWORDS and name in ("keywords", "tfidf", "gpt"):
        return PS.tuned(dataset)[name]
    if name == "keywords":
        return MA.KeywordMatcher(MA.KeywordParams(**free))
    if name == "tfidf":
        return MA.TfIdfMatcher(TF.TfIdfParams(**free))
    if name == "gpt":
        url = free.pop("url", None)
        transport = C.Retrying(C.HttpTransport(url, free.get("model", "gpt-3.5-turbo"), free.get("temperature", 0.75))) if url else MA.offline_transport
        return MA.PromptMatcher(transport=transport, **free)
    if name in ("word2vec", "fastText"):
        if not vectors:
            raise SystemExit("this model needs --vectors, a table that train has written")
        return MA.WordVectorMatcher(spark.read.parquet(vectors), T.tokens)
    if name in ("sentences", "transformer"):
        return (MA.SentenceMatcher if name == "sentences" else MA.TextVectorMatcher)(hashed(**free))
    raise SystemExit(f"unknown model {name}; known: {', '.join(MODELS)}")


MODELS = ("keywords", "tfidf", "gpt", "word2vec", "fastText", "sentences", "transformer")


def timed(pairs: DataFrame, score) -> list[dict]:
    """Seconds of five runs: first, again, one side of one pair changed, all of the other side changed, sides swapped;
    with the mean lengths of both texts."""
    from pyspark.sql import functions as F

    from pairforge.operators import pairs as P

    runs = {
        "first": pairs,
        "again": pairs,
        "changed_2": P.append_suffix(pairs, "text_2", when=F.col("pair_id") == 0),
        "changed_1": P.append_suffix(pairs, "text_1"),
        "swapped": P.swap(pairs),
    }
    out = []
    for name, df in runs.items():
        lengths = df.agg(F.avg(F.length("text_1")).alias("a"), F.avg(F.length("text_2")).alias("b")).first()
        wall, cpu = time.perf_counter(), time.process_time()
        score(df).write.format("noop").mode("overwrite").save()
        out.append({"scenario": name, "time": time.perf_counter() - wall, "process_time": time.process_time() - cpu, "text_1_len": lengths["a"] or 0.0, "text_2_len": lengths["b"] or 0.0})
    return out


def peak_memory(pairs: DataFrame, score) -> dict:
    """Peak memory of the driver's Python and of the largest of its ended workers, in MB, after one run."""
    import resource

    score(pairs).write.format("noop").mode("overwrite").save()
    return {"driver_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "worker_mb": resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss / 1024}


# ---- the commands; each takes the session, its arguments and the free parameters, and gives a table or None


def _params(spark, args, free):
    from dataclasses import fields

    from pairforge.operators import matchers as MA
    from pairforge.operators import tfidf as TF
    from pairforge.operators import training as TR

    kinds = {"keywords": MA.KeywordParams, "tfidf": TF.TfIdfParams, "gpt": MA.PromptMatcher, "word2vec": TR.TrainParams, "fastText": TR.TrainParams}
    if args.model not in kinds:
        raise SystemExit(f"no parameters are known of {args.model}")
    return spark.createDataFrame([(f.name, str(f.type), str(f.default)) for f in fields(kinds[args.model])], "name string, type string, default string")


def _match(spark, args, free):
    pairs = spark.createDataFrame([(0, args.text_1, args.text_2)], "pair_id long, text_1 string, text_2 string")
    print(_matcher(spark, args.model, free, vectors=args.vectors).score(pairs).first()["value"])


def _profile(spark, args, free):
    from pairforge.operators import pairs as P

    return P.profile(_pairs(spark, args))


def _scored(spark, args, free):
    from pyspark.sql import functions as F

    scored = _matcher(spark, args.model, free, args.dataset, args.vectors).score(_pairs(spark, args))
    return scored.withColumn("dataset", F.lit(args.dataset)).withColumn("model", F.lit(args.model))


def _evaluate(spark, args, free):
    from pairforge.operators import metrics as M

    scored = _scored(spark, args, free)
    return M.evaluate(scored, ["dataset", "model"]) if args.cutoff is None else M.confusion(scored, ["dataset", "model"], args.cutoff)


def _scores(spark, args, free):
    return _scored(spark, args, free).select("dataset", "model", "pair_id", "title_1", "title_2", "need_match", "value")


def _curve(spark, args, free):
    from pairforge.operators import metrics as M

    return (M.roc_curve if args.kind == "roc" else M.pr_curve)(_scored(spark, args, free), ["dataset", "model"])


def _search(spark, args, free):
    from pairforge.operators import experiments as EX

    key = EX.best_by(args.dataset)
    if args.model == "keywords":
        return EX.keyword_runs(_pairs(spark, args))
    if args.model == "tfidf":
        return EX.tfidf_runs(_pairs(spark, args), key=key)
    raise SystemExit("a search is there for keywords and tfidf")


def _timings(spark, args, free):
    rows = timed(_pairs(spark, args), _matcher(spark, args.model, free, args.dataset, args.vectors).score)
    return spark.createDataFrame([{"model": args.model} | r for r in rows])


def _timings_report(spark, args, free):
    from pairforge.operators import grid as G

    rows = spark.read.csv(args.path, header=True, inferSchema=True)
    return G.timing_report(rows, [r["scenario"] for r in rows.select("scenario").distinct().orderBy("scenario").collect()])


def _memory(spark, args, free):
    return spark.createDataFrame([peak_memory(_pairs(spark, args), _matcher(spark, args.model, free, args.dataset, args.vectors).score)])


def _grand_total(spark, args, free):
    """All models that need no trained vectors, and those whose vectors are in the folder, over one data set."""
    from pairforge.functions.encoders import hashed
    from pairforge.operators import pairs as P
    from pairforge.operators import presets as PS
    from pairforge.operators import training as TR
    from pairforge.sources import readers as R

    pairs = _pairs(spark, args)
    vectors = None
    if args.corpus:
        corpus = R.read_corpus(spark, args.corpus, args.field)
        vectors = lambda kind, params: TR.trained(spark, corpus, params, args.vectors or "vectors", "tokens", kind)
    return PS.run_all({args.dataset: pairs}, {args.dataset: PS.tuned(args.dataset, pairs, P.all_texts(pairs), vectors, hashed())})


def _train(spark, args, free):
    from pairforge.operators import training as TR
    from pairforge.sources import readers as R

    vectors = TR.train(R.read_corpus(spark, args.corpus, args.field), TR.TrainParams(**free), args.model)
    vectors.write.mode("overwrite").parquet(args.vectors)


def _preprocess(spark, args, free):
    from pairforge.functions import text as T
    from pairforge.sources import readers as R
    from pairforge.sources import sinks as SK

    SK.prepared_corpus(R.read_any(spark, args.path), args.field, T.preprocess(args.field), args.out or f"{args.path}.preprocessed.parquet")


def _cascade(spark, args, free):
    from pairforge.operators import training as TR
    from pairforge.sources import readers as R

    names = ("group", *TR.TrainParams.__dataclass_fields__)
    steps = [{k: v for k, v in r.asDict().items() if k in names} for r in R.read_scenario(spark, args.scenario).orderBy("step").collect()]
    log, best, value = TR.research(spark, steps, R.read_corpus(spark, args.corpus, args.field), R.read_benchmark(spark, args.path, args.text_1, args.text_2), args.vectors or "vectors", args.model)
    print(best, value)
    return spark.createDataFrame(log)


def _unit(spark, args, free):
    from pairforge.operators import metrics as M
    from pairforge.sources import readers as R

    scored = _matcher(spark, args.model, free, vectors=args.vectors).score(R.read_benchmark(spark, args.path, args.text_1, args.text_2))
    return (M.unit_max_f1 if args.command == "max-f1" else M.unit_roc_auc)(scored, [])


def _pairs(spark, args) -> DataFrame:
    from pairforge.sources import readers as R

    return R.load_dataset(spark, args.dataset, args.path)


_SET = ("dataset", "path")
#: Name: what it does, the command, its needed arguments, its optional ones.
COMMANDS = {
    "params": ("parameters of a model and their defaults", _params, (), ("model",)),
    "match": ("score two texts", _match, (), ("model", "vectors")),
    "profile": ("size, labels and lengths of a data set", _profile, _SET, ()),
    "evaluate": ("score a data set and measure it, at a cutoff or over all", _evaluate, _SET, ("model", "vectors", "cutoff")),
    "scores": ("the scores of a data set", _scores, _SET, ("model", "vectors")),
    "curve": ("the points of a ROC or precision-recall curve", _curve, _SET, ("model", "vectors", "kind")),
    "search": ("all runs of the search over a model's parameters", _search, _SET, ("model",)),
    "grand-total": ("all models with tuned parameters", _grand_total, _SET, ("corpus", "field", "vectors")),
    "timings": ("time a model in five scenarios", _timings, _SET, ("model", "vectors")),
    "timings-report": ("mean times by model and scenario of a written table", _timings_report, ("path",), ()),
    "memory": ("peak memory of one run", _memory, _SET, ("model", "vectors")),
    "train": ("train word vectors", _train, ("corpus", "vectors"), ("model", "field")),
    "preprocess": ("prepare the texts of a corpus", _preprocess, ("path",), ("field",)),
    "cascade": ("train along a scenario and keep the best", _cascade, ("scenario", "corpus", "path", "text_1", "text_2"), ("model", "field", "vectors")),
    "max-f1": ("best F1 of scores up to 1", _unit, ("path", "text_1", "text_2"), ("model", "vectors")),
    "roc-auc": ("area under the curve of scores up to 1", _unit, ("path", "text_1", "text_2"), ("model", "vectors")),
}
DEFAULTS = {"model": "keywords", "field": "preprocessed_text", "kind": "roc"}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairforge", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (text, _, needed, optional) in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        if name == "match":
            p.add_argument("text_1")
            p.add_argument("text_2")
        for option in needed:
            p.add_argument(f"--{option}", required=True)
        for option in optional:
            default = "word2vec" if option == "model" and name in ("train", "cascade", "max-f1", "roc-auc") else DEFAULTS.get(option)
            p.add_argument(f"--{option}", default=default, type=float if option == "cutoff" else str)
        p.add_argument("--out")
        p.add_argument("--master")
    args, rest = parser.parse_known_args(argv)
    from pairforge.sources import sinks as SK
    from pairforge.storage import intermediates

    spark = get_session(args.master)
    with intermediates():
        result = COMMANDS[args.command][1](spark, args, parse_free(rest))
        if result is None:
            return 0
        if args.out:
            SK.write_table(result, args.out, "append")
        else:
            result.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
